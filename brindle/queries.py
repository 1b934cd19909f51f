"""Registered queries over the relational tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import ValueError_
from brindle.functions.address import hash_bucket, is_owner, item_pointer, owner, tagged
from brindle.operators import join, mvcc
from brindle.operators.join import equi_join
from brindle.plans import Aggregate, Delete, Distinct, Filter, HashJoin, IndexScan, Insert, Limit, NestedLoopJoin, Project, RangeScan, RawInput, SeqScan, Update, lower
from brindle.session import read_table
from brindle.sources import datagen, kv, memory, scan
from brindle.sources.catalog import Catalog
from brindle.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def seq_scan(spark, d):
    return lower(SeqScan(read_table(spark, d, "nation"), ("n_nationkey", "n_name", "n_regionkey")))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def seq_scan_predicate(spark, d):
    return lower(SeqScan(read_table(spark, d, "lineitem"), ("l_orderkey", "l_partkey", "l_quantity"), "l_quantity > 45"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 17")
def index_scan(spark, d):
    return lower(Project(IndexScan(read_table(spark, d, "part"), "p_partkey", 17), {"p_partkey": "p_partkey", "p_name": "p_name", "p_retailprice": "p_retailprice"}))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def bitmap_scan(spark, d):
    return lower(SeqScan(read_table(spark, d, "orders"), ("o_orderkey", "o_custkey"), "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"))


def fixture_join(spark: SparkSession) -> DataFrame:
    """The small join whose result is known by hand."""
    outer = memory.batches(spark, [[(1, 2), (2, 3)], [(3, 4)]], "col_a int, col_b int")
    inner = memory.batches(spark, [[(1, 2), (4, 3)], [(3, 4), (5, 1)]], "col_a int, col_c int")
    return lower(HashJoin(RawInput(outer), RawInput(inner), (("col_a", "col_a"),)))


@query(
    """SELECT o.col_a AS l_col_a, o.col_b, i.col_a AS r_col_a, i.col_c
    FROM (VALUES (1, 2), (2, 3), (3, 4)) o(col_a, col_b) JOIN (VALUES (1, 2), (4, 3), (3, 4), (5, 1)) i(col_a, col_c) ON o.col_a = i.col_a"""
)
def inmem_join_fixture(spark, d):
    return fixture_join(spark)


@query(
    """SELECT o.k, concat(o.v, i.v) AS v
    FROM (VALUES (1, 'a1'), (1, 'a2'), (2, 'a1'), (2, 'a2'), (3, 'a1'), (3, 'a2')) o(k, v)
    JOIN (VALUES (1, 'm'), (2, 'n'), (3, 's'), (4, 'r'), (5, 'q'), (6, 'r'), (7, 's')) i(k, v) ON o.k = i.k"""
)
def text_join_fixture(spark, d):
    outer = memory.rows(spark, [(k, v) for k in (1, 2, 3) for v in ("a1", "a2")], "k int, v string")
    inner = memory.rows(spark, list(zip(range(1, 8), "mnsrqrs", strict=True)), "k int, v string")
    return lower(Project(HashJoin(RawInput(outer), RawInput(inner), (("k", "k"),)), {"k": "l_k", "v": "concat(l_v, r_v)"}))


@query(
    """SELECT o.k, o.v FROM (VALUES (1, 'a1'), (1, 'a2'), (2, 'a1'), (2, 'a2'), (3, 'a1'), (3, 'a2')) o(k, v)"""
)
def batch_replay(spark, d):
    return replay(memory.rows(spark, [(k, "a1"), (k, "a2")], "k int, v string") for k in (1, 2, 3))


GRACE = "SELECT o_orderkey, o_custkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"


def orders_customers(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    orders = SeqScan(read_table(spark, d, "orders"), ("o_orderkey", "o_custkey", "o_totalprice"))
    customers = SeqScan(read_table(spark, d, "customer"), ("c_custkey", "c_name"))
    return lower(HashJoin(orders, customers, (("o_custkey", "c_custkey"),), strategy)).select("o_orderkey", "o_custkey", "c_custkey", "c_name", "o_totalprice")


for _name, _strategy in (("grace_single", "auto"), ("merge_join", "merge"), ("broadcast_join", "broadcast"), ("shuffle_hash_join", "shuffle_hash")):
    query(GRACE, _name)(lambda spark, d, s=_strategy: orders_customers(spark, d, s))


@query(
    """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS l_l_partkey, b.l_partkey AS r_l_partkey
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"""
)
def grace_multi_key(spark, d):
    line = SeqScan(read_table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber", "l_partkey"))
    out = lower(HashJoin(line, line, (("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"))))
    return out.select(F.col("l_l_orderkey").alias("l_orderkey"), F.col("l_l_linenumber").alias("l_linenumber"), "l_l_partkey", "r_l_partkey")


@query("SELECT a.n_name AS l_n_name, b.n_name AS r_n_name, a.n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def grace_duplicate_keys(spark, d):
    n = SeqScan(read_table(spark, d, "nation"), ("n_name", "n_regionkey"))
    return lower(HashJoin(n, n, (("n_regionkey", "n_regionkey"),))).select("l_n_name", "r_n_name", F.col("l_n_regionkey").alias("n_regionkey"))


def _null_keys(spark: SparkSession, d: str, null_safe: bool) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 0)").alias("ck"))
    n = read_table(spark, d, "nation").select("n_name", F.expr("nullif(n_nationkey, 0)").alias("nk"))
    return equi_join(c, n, [("ck", "nk")], null_safe=null_safe).select("c_custkey", "ck", "n_name")


@query("SELECT c_custkey, nullif(c_nationkey, 0) AS ck, n_name FROM customer JOIN nation ON nullif(c_nationkey, 0) = nullif(n_nationkey, 0)")
def grace_null_keys(spark, d):
    return _null_keys(spark, d, False)


@query("SELECT c_custkey, nullif(c_nationkey, 0) AS ck, n_name FROM customer JOIN nation ON nullif(c_nationkey, 0) IS NOT DISTINCT FROM nullif(n_nationkey, 0)")
def null_safe_join(spark, d):
    return _null_keys(spark, d, True)


@query("SELECT a.k, count(*) AS pairs FROM (SELECT c_nationkey % 2 AS k FROM customer) a JOIN (SELECT c_nationkey % 2 AS k FROM customer) b ON a.k = b.k GROUP BY a.k")
def grace_skew(spark, d):
    """Pairs of a self join with two heavy keys, counted: each side is counted by key before the join, which then has a row a key."""
    k = lower(Aggregate(Project(SeqScan(read_table(spark, d, "customer"), ("c_nationkey",)), {"k": "c_nationkey % 2"}), ("k",), {"n": "count(*)"}))
    return equi_join(k, k, [("k", "k")]).select(F.col("l_k").alias("k"), (F.col("l_n") * F.col("r_n")).alias("pairs"))


@query("SELECT l_partkey, l_quantity, o_custkey FROM (SELECT CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_orderkey END AS k, * FROM lineitem) JOIN orders ON k = o_orderkey")
def skew_join(spark, d):
    """A join one of whose keys has a third of all rows."""
    line = read_table(spark, d, "lineitem").select(F.expr("CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_orderkey END").alias("k"), "l_partkey", "l_quantity", "l_linenumber")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return join.skew_join(line, orders, [("k", "o_orderkey")]).select("l_partkey", "l_quantity", "o_custkey")


@query("SELECT count(*) AS n FROM orders JOIN (SELECT * FROM customer WHERE c_custkey < 0) c ON o_custkey = c_custkey")
def grace_empty_side(spark, d):
    none = SeqScan(read_table(spark, d, "customer"), ("c_custkey",), "c_custkey < 0")
    return lower(Aggregate(HashJoin(SeqScan(read_table(spark, d, "orders"), ("o_custkey",)), none, (("o_custkey", "c_custkey"),)), (), {"n": "count(*)"}))


@query("SELECT a.n_name AS l_n_name, b.n_name AS r_n_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def nested_loop(spark, d):
    n = SeqScan(read_table(spark, d, "nation"), ("n_nationkey", "n_name"))
    return lower(NestedLoopJoin(n, n, "l_n_nationkey < r_n_nationkey")).select("l_n_name", "r_n_name")


@query("SELECT a.n_name AS l_n_name, b.n_regionkey AS n_regionkey FROM nation a JOIN nation b ON a.n_name = b.n_name")
def string_key(spark, d):
    n = read_table(spark, d, "nation")
    return equi_join(n.select("n_name"), n.select("n_name", "n_regionkey"), [("n_name", "n_name")]).select("l_n_name", "n_regionkey")


@query("SELECT a.n_name AS l_n_name, b.n_name AS r_n_name FROM nation a JOIN nation b ON CAST(a.n_nationkey AS DECIMAL(10, 2)) = CAST(b.n_nationkey AS DECIMAL(10, 2))")
def decimal_key(spark, d):
    n = read_table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("decimal(10,2)").alias("k"))
    return equi_join(n, n, [("k", "k")]).select("l_n_name", "r_n_name")


@query("SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lineitem_orders(spark, d):
    line = SeqScan(read_table(spark, d, "lineitem"), ("l_orderkey", "l_partkey"))
    return lower(HashJoin(line, SeqScan(read_table(spark, d, "orders"), ("o_orderkey", "o_custkey")), (("l_orderkey", "o_orderkey"),))).select("l_orderkey", "l_partkey", "o_custkey")


@query(
    """WITH k AS (SELECT o_custkey, CAST(CAST('0x' || substr(md5(concat_ws(chr(31), '0', CAST(o_custkey AS VARCHAR))), 1, 8) AS BIGINT) % 10 AS INTEGER) AS b0,
        CAST(CAST('0x' || substr(md5(concat_ws(chr(31), '1', CAST(o_custkey AS VARCHAR))), 1, 8) AS BIGINT) % 10 AS INTEGER) AS b1 FROM orders)
    SELECT b0, b1, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM k GROUP BY b0, b1"""
)
def hash_partition(spark, d):
    """Rows and keys of each bucket of a two-level partitioning by key hash."""
    o = read_table(spark, d, "orders").select("o_custkey")
    parts = o.select("o_custkey", hash_bucket(10, F.col("o_custkey")).alias("b0"), hash_bucket(10, F.col("o_custkey"), level=1).alias("b1"))
    return parts.groupBy("b0", "b1").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("keys"))


@query(
    """SELECT n_regionkey, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"""
)
def join_aggregate(spark, d):
    c = SeqScan(read_table(spark, d, "customer"), ("c_nationkey", "c_acctbal"))
    n = SeqScan(read_table(spark, d, "nation"), ("n_nationkey", "n_regionkey"))
    return lower(Aggregate(HashJoin(c, n, (("c_nationkey", "n_nationkey"),)), ("n_regionkey",), {"customers": "count(*)", "balance": "CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DECIMAL(28, 2))"}))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price FROM lineitem GROUP BY l_returnflag, l_linestatus")
def aggregate(spark, d):
    line = SeqScan(read_table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"))
    return lower(Aggregate(line, ("l_returnflag", "l_linestatus"), {"n": "count(*)", "min_qty": "min(l_quantity)", "max_price": "max(l_extendedprice)"}))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_topk(spark, d):
    return lower(Limit(SeqScan(read_table(spark, d, "orders"), ("o_orderkey", "o_totalprice")), 10, (F.desc("o_totalprice"), F.asc("o_orderkey"))))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return lower(Distinct(SeqScan(read_table(spark, d, "orders"), ("o_orderstatus", "o_orderpriority"))))


@query("SELECT count(DISTINCT user_id) AS users FROM events WHERE event_type = 'click'")
def count_distinct(spark, d):
    e = SeqScan(read_table(spark, d, "events"), ("user_id", "event_type"))
    return lower(Aggregate(Filter(e, "event_type = 'click'"), (), {"users": "count(DISTINCT user_id)"}))


@query(
    """SELECT n_nationkey, n_name, n_regionkey FROM nation
    UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), n_name, n_regionkey FROM nation WHERE n_regionkey = 1"""
)
def insert_select(spark, d):
    n = SeqScan(read_table(spark, d, "nation"), ("n_nationkey", "n_name", "n_regionkey"))
    more = Project(Filter(n, "n_regionkey = 1"), {"n_nationkey": "CAST(n_nationkey + 100 AS INT)", "n_name": "n_name", "n_regionkey": "n_regionkey"})
    return lower(Insert(n, more))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (25, 'ATLANTIS', 1), (26, NULL, NULL)) t(a, b, c)")
def insert_values(spark, d):
    """An insert of constants, in the target's types."""
    n = SeqScan(read_table(spark, d, "nation"), ("n_nationkey", "n_name", "n_regionkey"))
    one = RawInput(spark.range(1))
    for values in (("25", "'ATLANTIS'", "1"), ("26", "CAST(NULL AS STRING)", "CAST(NULL AS INT)")):
        n = Insert(n, Project(one, dict(zip(("n_nationkey", "n_name", "n_regionkey"), values, strict=True))))
    return lower(n)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_where(spark, d):
    c = SeqScan(read_table(spark, d, "customer"), ("c_custkey", "c_acctbal", "c_mktsegment"))
    return lower(Update(c, {"c_acctbal": "c_acctbal + 1"}, "c_mktsegment = 'BUILDING'"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete_where(spark, d):
    return lower(Delete(SeqScan(read_table(spark, d, "customer"), ("c_custkey", "c_acctbal")), "c_acctbal < 0"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 100)")
def get_tuples(spark, d):
    rids = memory.rows(spark, [(1,), (7,), (7,), (100,)], "rid bigint")
    return scan.get_tuples(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), rids, "o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey >= 10 AND p_partkey < 20")
def range_scan(spark, d):
    return lower(RangeScan(read_table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 10, 20))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 10 AND p_partkey <= 200 ORDER BY p_partkey DESC LIMIT 5")
def range_scan_reverse(spark, d):
    options = {"include_lower": False, "include_upper": True, "reverse": True}
    return lower(Limit(RangeScan(read_table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 10, 200, options), 5))


def _kv(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = read_table(spark, d, "nation")
    key = F.col("n_nationkey")
    base = n.select(key.alias("key"), F.col("n_name").alias("value"), F.lit(0).alias("seq"))
    moved = n.filter("n_regionkey = 1").select((key + F.lit(100)).alias("key"), F.col("n_name").alias("value"), F.lit(1).alias("seq"))
    changed = n.filter("n_regionkey = 2").select(key.alias("key"), F.lower("n_name").alias("value"), F.lit(2).alias("seq"))
    return base, moved.unionByName(changed)


@query(
    """SELECT CAST(CASE WHEN n_regionkey = 2 THEN n_nationkey ELSE n_nationkey END AS INTEGER) AS key,
        CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS value, CASE WHEN n_regionkey = 2 THEN 2 ELSE 0 END AS seq FROM nation
    UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), n_name, 1 FROM nation WHERE n_regionkey = 1"""
)
def kv_upsert(spark, d):
    return kv.upsert(*_kv(spark, d))


@query("SELECT n_nationkey AS key, n_name AS value, 0 AS seq FROM nation WHERE n_regionkey <> 2")
def kv_delete(spark, d):
    gone = read_table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("key"))
    return kv.delete(_kv(spark, d)[0], gone)


@query("SELECT o_orderkey AS rid, o_orderkey // 128 AS block, o_orderkey % 128 AS slot FROM orders")
def item_pointers(spark, d):
    block, slot = item_pointer(F.col("o_orderkey"))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), block.alias("block"), slot.alias("slot"))


@query("SELECT i AS row_id, i % 128 AS restarting, i AS running FROM range(1000) t(i)")
def gen_serial(spark, d):
    row = F.col("id")
    return spark.range(1000).select(row.alias("row_id"), datagen.serial(row).alias("restarting"), datagen.serial(row, None).alias("running"))


@query("SELECT i AS row_id, ((i * 1103515245 + 12345) % 2147483648) % 9 AS col_b FROM range(1000) t(i)")
def gen_uniform(spark, d):
    return spark.range(1000).select(F.col("id").alias("row_id"), datagen.uniform(F.col("id"), 0, 9).alias("col_b"))


@query(
    """SELECT CAST(i % 128 AS INTEGER) AS "colA", CAST(((i * 1103515245 + 12346) % 2147483648) % 9 AS INTEGER) AS "colB",
    CAST(((i * 1103515245 + 12347) % 2147483648) % 9999 AS INTEGER) AS "colC", CAST(i % 128 AS INTEGER) AS "colD" FROM range(1000) t(i)"""
)
def gen_table(spark, d):
    cols = [("colA", "Serial", 0, 0), ("colB", "Uniform", 0, 9), ("colC", "Uniform", 0, 9999), ("colD", "Serial", 0, 99999)]
    keys = ("name", "dist", "min", "max")
    return datagen.generate(spark, {"name": "test_1", "size": 1000, "cols": [dict(zip(keys, c, strict=True)) | {"type_id": "INTEGER", "nullable": False} for c in cols]})


@query("SELECT CAST(10 * n_nationkey AS INTEGER) AS col_a, CAST(10 * n_nationkey + 1 AS INTEGER) AS col_b, CAST(10 * n_nationkey + 2 AS DOUBLE) AS col_c FROM nation")
def populate(spark, d):
    return datagen.populate(read_table(spark, d, "nation"), "n_nationkey")


@query(
    """WITH p AS (SELECT n_nationkey AS i, ((n_nationkey * 1103515245 + 1) % 2147483648) % greatest((SELECT count(*) FROM nation) // 3, 1) AS b,
        ((n_nationkey * 1103515245 + 2) % 2147483648) * 2 + ((n_nationkey * 1103515245 + 3) % 2147483648) % 2 AS c FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)),
    q AS (SELECT i, b, (c * 10 + 2) % 4294967296 AS c FROM p)
    SELECT CAST(10 * i AS INTEGER) AS col_a, CAST(10 * b + 1 AS INTEGER) AS col_b, CAST(CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END AS DOUBLE) AS col_c FROM q"""
)
def populate_random(spark, d):
    n = read_table(spark, d, "nation")
    return datagen.populate(n, "n_nationkey", n.count())


@query("SELECT * FROM (VALUES ('id', 'int', 'made'), ('some_bool', 'boolean', 'made'), (NULL, NULL, 'taken'), (NULL, NULL, 'unknown')) t(name, kind, result)")
def catalog_tables(spark, d):
    """What the catalog tells of a table that is made, made again, dropped and looked for."""
    c, name = Catalog(spark), f"catalog_{uuid.uuid4().hex}"
    c.create_table(name, [("id", "INTEGER"), ("some_bool", "BOOL")])
    found = [(x.name, x.dataType.simpleString(), "made") for x in c.get_table(name)]
    for result, call in (("taken", lambda: c.create_table(name, [("id", "INTEGER")])), ("unknown", lambda: (c.drop_table(name), c.get_table(name)))):
        try:
            call()
        except ValueError_:
            found.append((None, None, result))
    return memory.rows(spark, found, "name string, kind string, result string")


VERSIONS = """WITH v AS (SELECT o_orderkey AS rid, o_custkey, o_orderdate AS begin_ts,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_ts FROM orders) """


def _versions(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), "o_custkey", "o_orderdate")
    return mvcc.versions_of(o, "o_custkey", "o_orderdate", "rid").drop("o_orderdate")


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(VERSIONS + "SELECT rid, o_custkey FROM v WHERE begin_ts < TIMESTAMP '1996-01-01' AND (end_ts IS NULL OR end_ts > TIMESTAMP '1996-01-01')")
def mvcc_snapshot(spark, d):
    return mvcc.snapshot(_versions(spark, d), _day("1996-01-01")).select("rid", "o_custkey")


@query(
    VERSIONS + """SELECT CASE WHEN NOT begin_ts < TIMESTAMP '1998-10-03' THEN 'invisible'
    WHEN end_ts IS NOT NULL AND NOT end_ts > TIMESTAMP '1998-10-03' THEN 'deleted' ELSE 'visible' END AS state, count(*) AS n FROM v GROUP BY 1"""
)
def mvcc_visibility(spark, d):
    state = mvcc.classify(_day("1998-10-03"), F.col("begin_ts"), F.col("end_ts"))
    return _versions(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(VERSIONS + "SELECT rid, o_custkey, begin_ts, coalesce(end_ts, TIMESTAMP '2002-01-01') AS end_ts FROM v")
def version_close(spark, d):
    return mvcc.close_versions(_versions(spark, d), _day("2002-01-01")).select("rid", "o_custkey", "begin_ts", "end_ts")


@query(
    """WITH v AS (SELECT o_orderkey AS rid, CAST(o_custkey AS BIGINT) AS begin_ts, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey + 100 AS BIGINT) END AS end_ts,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 5 END AS owner FROM orders),
    rw AS (SELECT o_orderkey // 5 AS tx, o_orderkey AS rid, CAST(o_custkey + o_orderkey % 4 - 1 AS BIGINT) AS commit_id FROM orders)
    SELECT tx, bool_and(coalesce(owner = tx, false) OR (owner IS NULL AND begin_ts <= commit_id AND (end_ts IS NULL OR end_ts >= commit_id))) AS commits
    FROM rw JOIN v USING (rid) GROUP BY tx"""
)
def occ_validation(spark, d):
    o = read_table(spark, d, "orders")
    v = o.selectExpr("o_orderkey AS rid", "o_custkey AS begin_ts", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 100 END AS end_ts", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey DIV 5 END AS owner")
    rw = o.selectExpr("o_orderkey DIV 5 AS tx", "o_orderkey AS rid", "o_custkey + o_orderkey % 4 - 1 AS commit_id")
    return mvcc.validate_commits(rw, v)


@query(
    """WITH t AS (SELECT c_custkey AS tx, ['processing', 'preparing', 'committed', 'aborted'][c_custkey % 4 + 1] AS state, CAST(c_custkey * 7 % 2000 AS BIGINT) AS ts FROM customer),
    v AS (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS begin_ts, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS begin_owner,
        CASE WHEN o_orderkey % 5 = 1 THEN o_custkey + 300 END AS end_ts, CASE WHEN o_orderkey % 5 IN (2, 3) THEN o_orderkey % 1000 END AS end_owner FROM orders),
    w AS (SELECT v.*, coalesce(b.state, 'aborted') AS bs, b.ts AS bt, coalesce(e.state, 'aborted') AS es, e.ts AS et FROM v LEFT JOIN t b ON b.tx = begin_owner LEFT JOIN t e ON e.tx = end_owner),
    x AS (SELECT *, coalesce(CASE WHEN begin_owner IS NULL THEN begin_ts < 900 WHEN bs = 'processing' THEN bt < 900 AND begin_owner = 4 WHEN bs IN ('preparing', 'committed') THEN bt < 900 END, false) AS begun,
        CASE WHEN end_owner IS NULL THEN end_ts IS NULL OR end_ts > 900 WHEN es = 'processing' THEN end_owner <> 4 WHEN es IN ('preparing', 'committed') THEN et > 900 ELSE true END AS alive FROM w)
    SELECT rid, CASE WHEN NOT begun THEN 'invisible' WHEN NOT alive THEN 'deleted' ELSE 'visible' END AS visibility,
        begun AND (begin_owner IS NOT NULL AND bs = 'preparing' OR end_owner IS NOT NULL AND es = 'preparing' AND NOT alive) AS speculative FROM x"""
)
def owner_visibility(spark, d):
    """What a transaction sees of versions that other transactions, or it itself, are writing."""
    state = F.element_at(F.array(*[F.lit(x) for x in ("processing", "preparing", "committed", "aborted")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    tx = read_table(spark, d, "customer").select(F.col("c_custkey").alias("tx"), state.alias("state"), (F.col("c_custkey") * 7 % 2000).alias("ts"))
    v = read_table(spark, d, "orders").selectExpr(
        "o_orderkey AS rid", "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS begin_ts", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS begin_owner",
        "CASE WHEN o_orderkey % 5 = 1 THEN o_custkey + 300 END AS end_ts", "CASE WHEN o_orderkey % 5 IN (2, 3) THEN o_orderkey % 1000 END AS end_owner",
    )
    return mvcc.visibility(v, tx, 900, 4).select("rid", "visibility", "speculative")


@query(
    """WITH o AS (SELECT o_orderkey // 3 AS tx, o_custkey AS rid, ['read', 'update', 'insert', 'delete', 'read', 'update'][o_orderkey % 6 + 1] AS op, o_totalprice AS value, o_orderkey AS seq FROM orders),
    v AS (SELECT c_custkey AS rid, c_acctbal AS value, CAST(1 AS BIGINT) AS begin_ts, CASE WHEN c_custkey % 10 = 0 THEN CAST(5000000 AS BIGINT) WHEN c_custkey % 7 = 0 THEN CAST(2 AS BIGINT) END AS end_ts FROM customer),
    k AS (SELECT tx, rid, list(op ORDER BY seq) AS ops, arg_max(value, CASE WHEN op IN ('update', 'insert') THEN seq END) AS value, 10 + tx % 5 AS begun, 4000000 + tx * 100 AS commit_ts FROM o GROUP BY tx, rid),
    a AS (SELECT *, CASE WHEN list_contains(ops, 'insert') AND list_contains(ops, 'delete') THEN 'insert_delete' WHEN list_contains(ops, 'delete') THEN 'delete'
        WHEN list_contains(ops, 'insert') THEN 'insert' WHEN list_contains(ops, 'update') THEN 'update' ELSE 'read' END AS access, NOT list_contains(ops[:-2], 'delete') AS sound FROM k),
    e AS (SELECT a.*, v.rid AS there, v.end_ts AS until, (SELECT count(*) FROM a b WHERE b.rid = a.rid AND b.commit_ts < a.commit_ts AND b.access <> 'read') AS earlier
        FROM a LEFT JOIN v ON v.rid = a.rid AND v.begin_ts < a.begun AND (v.end_ts IS NULL OR v.end_ts > a.begun)),
    c AS (SELECT tx FROM e GROUP BY tx HAVING bool_and(sound AND earlier = 0 AND CASE WHEN access IN ('insert', 'insert_delete') THEN there IS NULL ELSE there IS NOT NULL AND (until IS NULL OR until >= commit_ts) END)),
    w AS (SELECT a.* FROM a JOIN c USING (tx) WHERE access IN ('update', 'delete', 'insert'))
    SELECT v.rid, v.value, v.begin_ts, coalesce(v.end_ts, w.commit_ts) AS end_ts FROM v LEFT JOIN w USING (rid)
    UNION ALL SELECT rid, value, commit_ts, NULL FROM w WHERE access <> 'delete'"""
)
def transactions(spark, d):
    """Versions after transactions that run at once: reads, validation, installation."""
    k = F.col("o_orderkey")
    tx = F.floor(k / 3).cast("bigint")
    op = F.element_at(F.array(*[F.lit(x) for x in ("read", "update", "insert", "delete", "read", "update")]), (k % 6 + 1).cast("int"))
    o = read_table(spark, d, "orders")
    operations = o.select(tx.alias("tx"), F.col("o_custkey").alias("rid"), op.alias("op"), F.col("o_totalprice").alias("value"), k.alias("seq"))
    open_ = o.select(tx.alias("tx")).distinct().select("tx", (F.lit(10) + F.col("tx") % 5).alias("begin_ts"), (F.lit(4000000) + F.col("tx") * 100).alias("commit_ts"))
    v = read_table(spark, d, "customer").selectExpr("c_custkey AS rid", "c_acctbal AS value", "1L AS begin_ts", "CASE WHEN c_custkey % 10 = 0 THEN 5000000L WHEN c_custkey % 7 = 0 THEN 2L END AS end_ts")
    return mvcc.transact(v, operations, open_)[1]


LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")


@query(
    """SELECT * FROM (VALUES ('read_uncommitted', 'growing', 'abort', NULL), ('read_uncommitted', 'shrinking', 'abort', NULL), ('read_committed', 'growing', 'true', 20), ('read_committed', 'shrinking', 'true', 20),
    ('repeatable_read', 'growing', 'true', 10), ('repeatable_read', 'shrinking', 'abort', 10), ('serializable', 'growing', 'true', 10), ('serializable', 'shrinking', 'true', 10)) t(isolation, phase, shared_lock, read_ts)"""
)
def isolation_rules(spark, d):
    """Whether a transaction gets a shared lock, and the time it reads at, by isolation level."""
    found = [(level, phase, str(mvcc.shared_lock(level, phase, False)).lower(), mvcc.read_timestamp(level, 10, 20)) for level in LEVELS for phase in ("growing", "shrinking")]
    return memory.rows(spark, found, "isolation string, phase string, shared_lock string, read_ts int")


@query("SELECT * FROM (VALUES ('read','read',true),('read','write',true),('read','certify',false),('write','read',true),('write','write',false),('write','certify',false),('certify','read',false),('certify','write',false),('certify','certify',false)) t(held, wanted, compatible)")
def lock_matrix(spark, d):
    return mvcc.lock_matrix(spark)


@query(
    """WITH RECURSIVE deps(tx, depends_on) AS (VALUES (21, 1), (21, 2), (22, 1), (22, 2), (31, 21), (31, 22), (32, 21), (32, 22), (41, 31), (42, 99)),
    gone(tx) AS (SELECT 2 UNION SELECT d.tx FROM deps d JOIN gone g ON d.depends_on = g.tx) SELECT CAST(tx AS BIGINT) AS tx FROM gone"""
)
def cascading_abort(spark, d):
    pairs = [(21, 1), (21, 2), (22, 1), (22, 2), (31, 21), (31, 22), (32, 21), (32, 22), (41, 31), (42, 99)]
    return mvcc.cascading_abort(memory.rows(spark, pairs, "tx bigint, depends_on bigint"), memory.rows(spark, [(2,)], "tx bigint"))


@query(
    """WITH RECURSIVE deps AS (SELECT o_orderkey AS tx, o_orderkey - 1 AS depends_on FROM orders WHERE o_orderkey % 1500 <> 0
        UNION ALL SELECT o_orderkey, o_orderkey - 7 FROM orders WHERE o_orderkey % 100 = 50),
    gone(tx) AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3000 = 40 UNION SELECT d.tx FROM deps d JOIN gone g ON d.depends_on = g.tx) SELECT tx FROM gone"""
)
def cascading_abort_deep(spark, d):
    """Chains of 1500 transactions, some with a second dependency."""
    o = read_table(spark, d, "orders")
    deps = o.filter("o_orderkey % 1500 <> 0").selectExpr("o_orderkey AS tx", "o_orderkey - 1 AS depends_on").unionAll(o.filter("o_orderkey % 100 = 50").selectExpr("o_orderkey AS tx", "o_orderkey - 7 AS depends_on"))
    return mvcc.cascading_abort(deps, o.filter("o_orderkey % 3000 = 40").selectExpr("o_orderkey AS tx"))


@query("SELECT 3 AS key, n_name AS value, 0 AS seq FROM nation WHERE n_nationkey = 3")
def kv_get(spark, d):
    return kv.get(_kv(spark, d)[0], 3)


@query("SELECT o_orderkey AS rid, o_orderkey % 5 = 0 AS owned, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS owner, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS ts FROM orders")
def tagged_words(spark, d):
    word = F.when(F.col("o_orderkey") % 5 == 0, tagged(F.col("o_custkey"))).otherwise(F.col("o_orderkey"))
    w = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), word.alias("word"))
    return w.select("rid", is_owner(F.col("word")).alias("owned"), owner(F.col("word")).alias("owner"), F.when(~is_owner(F.col("word")), F.col("word")).alias("ts"))


@query(
    """WITH o AS (SELECT o_custkey AS tx, o_orderkey % 3 AS rid, ['read', 'update', 'insert', 'delete'][o_orderkey // 3 % 4 + 1] AS op, o_orderkey AS seq FROM orders),
    k AS (SELECT tx, rid, list(op ORDER BY seq) AS ops FROM o GROUP BY tx, rid)
    SELECT tx, rid, CASE WHEN list_contains(ops, 'insert') AND list_contains(ops, 'delete') THEN 'insert_delete' WHEN list_contains(ops, 'delete') THEN 'delete'
        WHEN list_contains(ops, 'insert') THEN 'insert' WHEN list_contains(ops, 'update') THEN 'update' ELSE 'read' END AS access,
        NOT list_contains(ops[:-2], 'delete') AS sound FROM k"""
)
def access_sets(spark, d):
    op = F.element_at(F.array(*[F.lit(x) for x in ("read", "update", "insert", "delete")]), (F.floor(F.col("o_orderkey") / 3) % 4 + 1).cast("int"))
    o = read_table(spark, d, "orders")
    return mvcc.access_sets(o.select(F.col("o_custkey").alias("tx"), (F.col("o_orderkey") % 3).alias("rid"), op.alias("op"), F.col("o_orderkey").alias("seq")))


@query(
    """WITH w AS (SELECT CASE WHEN o_orderkey % 5 IN (2, 4) THEN o_orderkey + 1000000 ELSE o_custkey END AS rid, o_orderkey % 5 AS op, o_totalprice AS value, o_orderkey + 10 AS ts FROM orders),
    e AS (SELECT * FROM w WHERE op IN (0, 1, 2)),
    v AS (SELECT c_custkey AS rid, 9 AS op, c_acctbal AS value, CAST(1 AS BIGINT) AS ts FROM customer UNION ALL SELECT * FROM e),
    x AS (SELECT *, (SELECT min(n.ts) FROM e n WHERE n.rid = v.rid AND n.ts > v.ts) AS end_ts FROM v)
    SELECT rid, value, ts AS begin_ts, end_ts FROM x WHERE op <> 1"""
)
def commit_install(spark, d):
    """Updates, deletes and inserts, and inserts deleted again, of many transactions."""
    k = F.col("o_orderkey")
    access = F.element_at(F.array(*[F.lit(x) for x in ("update", "delete", "insert", "read", "insert_delete")]), (k % 5 + 1).cast("int"))
    rid = F.when((k % 5).isin(2, 4), k + 1000000).otherwise(F.col("o_custkey"))
    writes = read_table(spark, d, "orders").select(rid.alias("rid"), access.alias("access"), F.col("o_totalprice").alias("value"), (k + 10).alias("commit_ts"))
    versions = read_table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("value"), F.lit(1).cast("bigint").alias("begin_ts"), F.lit(None).cast("bigint").alias("end_ts"))
    return mvcc.install(versions, writes)
