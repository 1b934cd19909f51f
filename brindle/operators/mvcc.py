"""Versions of rows: snapshots, visibility, commit validation and dependent aborts.

A version has ``begin_ts`` and ``end_ts`` (null: open). A version that a running transaction has
written has that transaction's id in ``begin_owner`` or ``end_owner`` in place of the timestamp.
Bounds are strict at both ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.errors import ConfigError
from brindle.session import materialize, release, scratch


def versions_of(df: DataFrame, key: str, begin: str, tie: str) -> DataFrame:
    """Versions by key: each lasts until the next one of its key begins."""
    w = Window.partitionBy(key).orderBy(begin, tie)
    return df.withColumn("begin_ts", F.col(begin)).withColumn("end_ts", F.lead(begin).over(w))


def _total(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def snapshot(versions: DataFrame, read_ts: Column) -> DataFrame:
    """Versions that a read at ``read_ts`` sees."""
    return versions.filter(_total(F.col("begin_ts") < read_ts) & (F.col("end_ts").isNull() | _total(F.col("end_ts") > read_ts)))


def classify(read_ts: Column, begin: Column, end: Column) -> Column:
    """invisible, deleted or visible for committed versions."""
    return F.when(~_total(begin < read_ts), "invisible").when(end.isNotNull() & ~_total(end > read_ts), "deleted").otherwise("visible")


def visibility(versions: DataFrame, transactions: DataFrame, read_ts: int, reader: int) -> DataFrame:
    """Adds ``visibility`` and ``speculative`` for versions that may be owned by transactions.

    ``transactions`` has tx, state (processing, preparing, committed, aborted) and ts. A speculative
    result holds only if the owner, which is preparing, commits. An owner that isn't listed counts as
    aborted.
    """
    now, me = F.lit(read_ts), F.lit(reader)
    b = transactions.select(F.col("tx").alias("_b_tx"), F.col("state").alias("_b_state"), F.col("ts").alias("_b_ts"))
    e = transactions.select(F.col("tx").alias("_e_tx"), F.col("state").alias("_e_state"), F.col("ts").alias("_e_ts"))
    df = versions.join(b, F.col("begin_owner") == F.col("_b_tx"), "left").join(e, F.col("end_owner") == F.col("_e_tx"), "left")
    b_state, e_state = (F.coalesce(F.col(c), F.lit("aborted")) for c in ("_b_state", "_e_state"))
    own_begin, own_end = _total(F.col("begin_owner") == me), _total(F.col("end_owner") == me)
    later = _total(now > F.col("_b_ts"))
    begins = (
        F.when(F.col("begin_owner").isNull(), _total(now > F.col("begin_ts")))
        .when(b_state == "processing", later & own_begin)
        .when(b_state.isin("preparing", "committed"), later)
        .otherwise(F.lit(False))
    )
    before_end = _total(now < F.col("_e_ts"))
    alive = (
        F.when(F.col("end_owner").isNull(), F.col("end_ts").isNull() | _total(now < F.col("end_ts")))
        .when(e_state == "processing", ~own_end)
        .when(e_state.isin("preparing", "committed"), before_end)
        .otherwise(F.lit(True))
    )
    speculative = _total(F.col("begin_owner").isNotNull() & (b_state == "preparing") & begins) | _total(F.col("end_owner").isNotNull() & (e_state == "preparing") & begins & ~alive)
    result = F.when(~begins, "invisible").when(~alive, "deleted").otherwise("visible")
    return df.withColumn("visibility", result).withColumn("speculative", speculative).drop("_b_tx", "_b_state", "_b_ts", "_e_tx", "_e_state", "_e_ts")


def close_versions(versions: DataFrame, commit_ts: Column) -> DataFrame:
    """Open versions end at the commit: the first half of an update, or a delete."""
    return versions.withColumn("end_ts", F.coalesce(F.col("end_ts"), commit_ts))


def validate_commits(read_write: DataFrame, versions: DataFrame, key: str = "rid") -> DataFrame:
    """Whether each transaction may commit.

    ``read_write`` has tx, commit_id and the key; ``versions`` has the key, begin_ts, end_ts and owner.
    An entry is valid if its transaction owns the version, or nobody does and the version begins no
    later and ends no earlier than the commit. A transaction without a version for an entry aborts.
    """
    v = versions.select(F.col(key).alias("_key"), "begin_ts", "end_ts", "owner")
    joined = read_write.join(v, read_write[key] == v["_key"], "left")
    own = _total(F.col("owner") == F.col("tx"))
    free = F.col("_key").isNotNull() & F.col("owner").isNull() & _total(F.col("begin_ts") <= F.col("commit_id")) & (F.col("end_ts").isNull() | _total(F.col("end_ts") >= F.col("commit_id")))
    return joined.groupBy("tx").agg(F.bool_and(own | free).alias("commits"))


def access_sets(operations: DataFrame) -> DataFrame:
    """What each transaction has done to each row in all: columns tx, rid, access and sound.

    ``operations`` has tx, rid, op (read, update, insert, delete) and seq. A row that a transaction
    inserts and deletes is ``insert_delete``; else a delete counts before an insert, an insert before an
    update, and these before a read. It is not sound to touch a row after its delete.
    """
    has = lambda op: F.bool_or(F.col("op") == op)
    gone = F.min(F.when(F.col("op") == "delete", F.col("seq")))
    last = F.max("seq")
    done = operations.groupBy("tx", "rid").agg(has("insert").alias("i"), has("delete").alias("d"), has("update").alias("u"), gone.alias("gone"), last.alias("last"))
    access = F.when(F.col("i") & F.col("d"), "insert_delete").when(F.col("d"), "delete").when(F.col("i"), "insert").when(F.col("u"), "update").otherwise("read")
    return done.select("tx", "rid", access.alias("access"), (F.col("gone").isNull() | (F.col("last") <= F.col("gone"))).alias("sound"))


def install(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """The versions after commits: rid, value, begin_ts and end_ts.

    ``writes`` has rid, access, value and commit_ts of transactions that may commit. An update ends the
    open version and begins another one, a delete only ends it, an insert only begins one, and an
    insert that was deleted again leaves nothing. Commits to one row take effect in order of time.
    """
    w = writes.filter(F.col("access").isin("update", "delete", "insert")).select("rid", "access", "value", "commit_ts")
    ends = w.groupBy(F.col("rid").alias("_rid")).agg(F.min("commit_ts").alias("_ts"))
    old = versions.join(ends, F.col("rid") == F.col("_rid"), "left")
    old = old.select("rid", "value", "begin_ts", F.coalesce("end_ts", "_ts").alias("end_ts"))
    after = F.lead("commit_ts").over(Window.partitionBy("rid").orderBy("commit_ts"))
    new = w.select("rid", "access", "value", F.col("commit_ts").alias("begin_ts"), after.alias("end_ts")).filter(F.col("access") != "delete")
    return old.unionByName(new.drop("access"))


def cascading_abort(dependencies: DataFrame, aborted: DataFrame) -> DataFrame:
    """All transactions that abort: those given and whatever depends on them, directly or not.

    ``dependencies`` has tx and depends_on and may have cycles and repeated rows; nulls are left out.
    Transactions with one dependency pass on what becomes of it, so chains of them are first shortened by
    pointer doubling, in rounds logarithmic in their length (a chain that ends in a cycle never aborts).
    What is left is searched from the aborted ones in rounds, as many as the longest path through
    transactions with several dependencies. Every round is written to shared storage, so plans stay small.
    """
    with scratch() as keep:
        deps = dependencies.select("tx", "depends_on").filter("tx IS NOT NULL AND depends_on IS NOT NULL").distinct()
        gone = materialize(aborted.select("tx").filter("tx IS NOT NULL").distinct(), "aborted")
        deps = materialize(deps.join(gone, "tx", "left_anti"), "dependencies")
        degree = materialize(deps.groupBy("tx").agg(F.min("depends_on").alias("to"), F.count("*").alias("n")), "degrees")
        jump = materialize(degree.filter("n = 1").select("tx", "to"), "jumps")
        left = None
        while True:
            step = jump.select(F.col("tx").alias("_tx"), F.col("to").alias("_to"))
            after = materialize(jump.join(step, F.col("to") == F.col("_tx"), "left").select("tx", F.coalesce("_to", "to").alias("to"), F.col("_tx").isNotNull().alias("open")), "jumps")
            now = after.filter("open").count()  # it falls in each round until only ways into cycles are left
            release(jump)
            jump = after.select("tx", "to") if not now else materialize(after.select("tx", "to"), "jumps")
            if not now or now == left:
                break
            release(after)
            left = now
        ends = jump.select(F.col("tx").alias("_tx"), F.col("to").alias("_to"))
        several = deps.join(degree.filter("n > 1"), "tx", "left_semi").join(ends, F.col("depends_on") == F.col("_tx"), "left")
        several = materialize(several.select("tx", F.coalesce("_to", "depends_on").alias("depends_on")).distinct(), "several")
        known, frontier = [gone], gone
        while True:
            hit = several.join(frontier.select(F.col("tx").alias("_gone")), F.col("depends_on") == F.col("_gone"), "left_semi").select("tx").distinct()
            frontier = materialize(hit.join(reduce(DataFrame.unionByName, known), "tx", "left_anti"), "aborted")
            if frontier.isEmpty():
                break
            known.append(frontier)
            if len(known) > 8:
                known = [materialize(reduce(DataFrame.unionByName, known), "aborted")]
        found = reduce(DataFrame.unionByName, known)
        behind = jump.join(found.select(F.col("tx").alias("_gone")), F.col("to") == F.col("_gone"), "left_semi").select("tx")
        return keep(materialize(found.unionByName(behind), "aborted"))


def transact(versions: DataFrame, operations: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs transactions that are all open at once, each begun before any commits: reads, validation and installation.

    ``versions`` has rid, value, begin_ts and end_ts, ``operations`` tx, rid, op (read, update, insert,
    delete), value and seq, ``transactions`` tx, begin_ts and commit_ts. Returns tx and commits, a row for
    each transaction that has operations, and the versions afterwards.

    An operation reads the version at its transaction's begin. A transaction commits if all it did to
    each row is sound, what it read or changed was there and what it inserted was not, no version that it
    read ends before its commit, and no transaction that comes earlier in the order of commits changes a
    row that it touches; those that abort themselves count here, too, so none has to wait for another.
    """
    sets = access_sets(operations).join(transactions.select("tx", F.col("begin_ts").alias("_begin"), "commit_ts"), "tx")
    last = operations.filter(F.col("op").isin("update", "insert")).groupBy("tx", "rid").agg(F.max_by("value", "seq").alias("value"))
    live = versions.select(F.col("rid").alias("_rid"), F.col("begin_ts").alias("_from"), F.col("end_ts").alias("_to"))
    entries = sets.join(live, (F.col("rid") == F.col("_rid")) & (F.col("_from") < F.col("_begin")) & (F.col("_to").isNull() | (F.col("_to") > F.col("_begin"))), "left")
    writes, new = F.col("access") != "read", F.col("access").isin("insert", "insert_delete")
    before = Window.partitionBy("rid").orderBy("commit_ts", "tx").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("_writer", F.max(F.when(writes, F.col("commit_ts"))).over(before))
    there = F.when(new, F.col("_rid").isNull()).otherwise(F.col("_rid").isNotNull() & (F.col("_to").isNull() | (F.col("_to") >= F.col("commit_ts"))))
    free = F.col("_writer").isNull()
    done = entries.groupBy("tx").agg(F.bool_and(F.col("sound") & there & free).alias("commits"))
    good = sets.join(done.filter("commits"), "tx", "left_semi").join(last, ["tx", "rid"], "left")
    return done, install(versions, good)


#: Which lock modes two transactions can hold at once: fixed values of the protocol.
LOCK_MATRIX = (
    ("read", "read", True),
    ("read", "write", True),
    ("read", "certify", False),
    ("write", "read", True),
    ("write", "write", False),
    ("write", "certify", False),
    ("certify", "read", False),
    ("certify", "write", False),
    ("certify", "certify", False),
)


def lock_matrix(spark: SparkSession) -> DataFrame:
    """The compatibility of lock modes as a table."""
    return spark.createDataFrame(LOCK_MATRIX, "held string, wanted string, compatible boolean")


def shared_lock(isolation: str, phase: str, held: bool) -> bool | str:
    """Whether a two-phase transaction gets a shared lock: True, or ``abort``."""
    if isolation not in ("read_uncommitted", "read_committed", "repeatable_read", "serializable"):
        raise ConfigError(f"unknown isolation level {isolation}")
    if held:
        return True
    if isolation == "read_uncommitted" or isolation == "repeatable_read" and phase == "shrinking":
        return "abort"
    return True


def read_timestamp(isolation: str, begin_ts: int, statement_ts: int) -> int | None:
    """The time a statement reads at; None reads the newest version, committed or not."""
    if isolation == "read_uncommitted":
        return None
    if isolation == "read_committed":
        return statement_ts
    if isolation in ("repeatable_read", "serializable"):
        return begin_ts
    raise ConfigError(f"unknown isolation level {isolation}")
