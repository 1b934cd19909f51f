"""Operators on small tables whose results are known by hand."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from brindle import errors
from brindle.functions.address import hash_bucket, is_owner, item_pointer, owner, tagged
from brindle.functions.types import type_of
from brindle.operators import dml, join, mvcc, relational
from brindle.operators.join import equi_join, nested_loop_join
from brindle.plans import Delete, RawInput, SeqScan, lower
from brindle.queries import fixture_join
from brindle.sources import datagen, kv, memory, scan
from brindle.sources.catalog import Catalog
from brindle.streaming import replay

STRATEGIES = ("auto", "merge", "shuffle_hash", "broadcast")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fixture_join(spark):
    df = fixture_join(spark)
    assert df.columns == ["l_col_a", "col_b", "r_col_a", "col_c"]
    assert values(df) == [(1, 2, 1, 2), (3, 4, 3, 4)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_join_semantics(spark, strategy):
    a = memory.rows(spark, [(1, "x", 1), (1, "x", 2), (None, "x", 3), (2, None, 4), (3, "z", 5)], "k int, s string, a int")
    b = memory.rows(spark, [(1, "x", 10), (1, "x", 11), (None, "x", 12), (2, None, 13), (4, "z", 14)], "k int, s string, b int")
    out = equi_join(a, b, [("k", "k"), ("s", "s")], strategy).select("a", "b")
    assert values(out) == [(1, 10), (1, 11), (2, 10), (2, 11)]
    safe = equi_join(a, b, [("k", "k"), ("s", "s")], strategy, null_safe=True).select("a", "b")
    assert values(safe) == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (4, 13)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_join_with_an_empty_side(spark, strategy):
    some, none = memory.rows(spark, [(1,)], "k int"), memory.rows(spark, [], "k int")
    assert values(equi_join(some, none, [("k", "k")], strategy)) == values(equi_join(none, some, [("k", "k")], strategy)) == []


def test_join_of_one_heavy_key(spark):
    a = spark.range(2000).select(F.lit(1).alias("k"), "id")
    assert equi_join(a, a, [("k", "k")], "merge").count() == 4_000_000


@pytest.mark.parametrize("kind", ["decimal(10,2)", "string", "double", "timestamp_ntz", "boolean", "tinyint", "date"])
def test_key_types(spark, kind):
    text = {"timestamp_ntz": "2020-01-01 00:00:00", "date": "2020-01-01", "boolean": "true"}.get(kind, "1")
    a = memory.rows(spark, [(text,), (None,)], "k string").select(F.col("k").cast(kind).alias("k"))
    assert equi_join(a, a, [("k", "k")]).count() == 1


def test_join_errors(spark):
    a = memory.rows(spark, [(1, "1", {1: 1})], "k int, s string, m map<int,int>")
    with pytest.raises(errors.ConfigError):
        equi_join(a, a, [])
    with pytest.raises(errors.ConfigError):
        equi_join(a, a, [("k", "k")], "nested")
    for on in ([("k", "s")], [("k", "nope")], [("m", "m")]):
        with pytest.raises(errors.ValueError_):
            equi_join(a, a, on)
    assert equi_join(a.select("k"), a.select(F.col("k").cast("bigint").alias("j")), [("k", "j")]).count() == 1


def test_plans_show_the_strategy(spark):
    a = spark.range(100).toDF("k")
    for strategy, node in (("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")):
        df = equi_join(a, a, [("k", "k")], strategy)
        assert node in df._jdf.queryExecution().executedPlan().toString()


def test_a_large_side_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("brindle.operators.join.BROADCAST_LIMIT", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = equi_join(spark.range(100).toDF("k"), spark.range(100).toDF("k"), [("k", "k")], "broadcast")
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skew_join(spark):
    rng = random.Random(1)
    left = [(rng.choice([None, 1, 1, 1, 1, *range(60)]), i) for i in range(900)] + [(1, 5)] * 20
    a, b = memory.rows(spark, left, "k int, v int"), memory.rows(spark, [(k % 70 if k else None, k) for k in range(140)], "k int, w int")
    for null_safe in (False, True):
        memory.assert_same_rows(join.skew_join(a, b, [("k", "k")], null_safe=null_safe), equi_join(a, b, [("k", "k")], null_safe=null_safe))
    assert join.skew_join(a.limit(0), b, [("k", "k")]).count() == 0
    with pytest.raises(errors.ConfigError):
        join.skew_join(a, b, [("k", "k")], share=0)


def test_shared_folder_of_a_cluster(spark):
    from types import SimpleNamespace

    from brindle.session import qualified, shared_folder

    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", applicationId="a")
    with pytest.raises(errors.ConfigError):
        shared_folder(SimpleNamespace(sparkContext=context))
    assert qualified(spark, "/x/y") == "file:///x/y" and qualified(spark, "file:/x") == "file:///x"


def test_entry_without_operators(monkeypatch, tmp_path):
    """A module of the operators that can't be imported leaves the other queries alone."""
    import sys

    assert "op1_license_scan" not in __spark_entry__.relational.QUERIES
    monkeypatch.setitem(sys.modules, "brindle.llm", None)
    for name in [m for m in sys.modules if m.startswith("brindle.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert set(__spark_entry__.queries()) == set(__spark_entry__.relational.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(__spark_entry__.relational.SQL)
    monkeypatch.delitem(sys.modules, "brindle.llm")
    (tmp_path / "broken_part.py").write_text("import no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="no_such_module"):
        assert __spark_entry__.optional("broken_part") is None
    assert __spark_entry__.optional("not_there_at_all") is None


def test_nested_loop(spark):
    a = memory.rows(spark, [(1,), (2,), (3,)], "x int")
    assert values(nested_loop_join(a, a, "l_x < r_x")) == [(1, 2), (1, 3), (2, 3)]


def test_pushdown(spark, small):
    df = lower(SeqScan(spark.read.parquet(f"{small}/lineitem.parquet"), ("l_orderkey",), "l_quantity > 45"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_relational(spark):
    a = memory.rows(spark, [(1, None), (1, 2), (2, 5), (2, 5)], "k int, v int")
    assert values(relational.aggregate(a, ["k"], {"n": "count(*)", "s": "sum(v)"})) == [(1, 2, 2), (2, 2, 10)]
    assert values(relational.aggregate(a.filter("k > 9"), [], {"n": "count(*)", "s": "sum(v)"})) == [(0, None)]
    assert relational.distinct(a).count() == 3 and relational.distinct(a, ["k"]).count() == 2
    assert values(relational.limit(a, 1, [F.desc("v"), F.asc("k")])) == [(2, 5)]
    assert values(relational.where(a, "v > 2")) == [(2, 5), (2, 5)]
    assert values(relational.project(a, {"w": "v + 1"}))[0] == (3,)
    for wrong in (lambda: relational.limit(a, -1), lambda: relational.aggregate(a, ["k"], {})):
        with pytest.raises(errors.ConfigError):
            wrong()


def test_three_valued_changes(spark):
    a = memory.rows(spark, [(1, 5), (2, None), (3, -1)], "k int, v int")
    assert values(dml.delete(a, "v < 0")) == [(1, 5), (2, None)]
    assert values(lower(Delete(RawInput(a), "v IS NULL"))) == [(1, 5), (3, -1)]
    assert values(dml.update(a, {"v": "v * 10"}, "v > 0")) == [(1, 50), (2, None), (3, -1)]
    assert values(dml.update(a, {"k": "k + 1", "v": "k"}, F.lit(True))) == [(2, 1), (3, 2), (4, 3)]
    with pytest.raises(errors.ValueError_):
        dml.update(a, {"w": "1"}, "true")
    with pytest.raises(errors.ValueError_):
        dml.insert(a, a.select("k"))


def test_table_versions(spark, tmp_path):
    t = dml.Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(errors.ValueError_):
        t.read()
    assert t.write(memory.rows(spark, [(1,), (2,)], "k int")) == 0
    assert t.write(dml.delete(t.read(), "k = 1")) == 1
    assert values(t.read()) == [(2,)] and values(t.read(0)) == [(1,), (2,)]
    with pytest.raises(errors.ValueError_):
        t.read(7)
    slow, fast = dml.Table(spark, t.path), dml.Table(spark, t.path)
    slow.versions = lambda: [0]  # it looked before the other one wrote
    assert fast.write(memory.rows(spark, [(9,)], "k int")) == 2
    with pytest.raises(errors.SerializationError):
        slow.write(memory.rows(spark, [(5,)], "k int"))
    assert values(t.read()) == [(9,)] and sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".v")) == ["v0", "v1", "v2"]


@pytest.mark.parametrize(
    "inserts,deletes,left",
    [(range(1, 6), [2], [1, 3, 4, 5]), (range(1, 4), [2, 1], [3]), (range(10, 0, -1), [10, 9, 8], list(range(1, 8))), (range(1, 9), [4], [1, 2, 3, 5, 6, 7, 8]), (range(1, 6), [5, 4, 3, 2], [1]), ([1, 3, 5, 9, 10], [99], [1, 3, 5, 9, 10])],
)
def test_ordered_keys(spark, inserts, deletes, left):
    table = memory.rows(spark, [(k, 0) for k in inserts], "main bigint, sub bigint")
    table = kv.delete(table, memory.rows(spark, [(k,) for k in deletes], "main bigint"), "main")
    assert [r["main"] for r in scan.range_scan(table, "main").collect()] == left
    assert [r["main"] for r in scan.range_scan(table, "main", reverse=True).collect()] == left[::-1]


def test_range_bounds(spark):
    t = spark.range(10).toDF("k")
    get = lambda *a, **b: [r["k"] for r in scan.range_scan(t, "k", *a, **b).collect()]
    assert get(2, 5) == [2, 3, 4] and get(2, 5, include_lower=False, include_upper=True) == [3, 4, 5]
    assert get(None, 2) == [0, 1] and get(8) == [8, 9] and get(5, 5) == [] and get(7, 3) == []
    assert values(scan.index_scan(t, "k", 4)) == [(4,)]


def test_kv(spark):
    base = memory.rows(spark, [(1, "a", 0), (2, "b", 0)], "key int, value string, seq int")
    writes = memory.rows(spark, [(2, "c", 2), (2, "d", 1), (3, "e", 1)], "key int, value string, seq int")
    now = kv.upsert(base, writes)
    assert values(now) == [(1, "a", 0), (2, "c", 2), (3, "e", 1)]
    assert values(kv.get(now, 3)) == [(3, "e", 1)] and values(kv.get(now, 9)) == []


def test_catalog(spark):
    c = Catalog(spark)
    made = c.create_table("test_catalog", [("id", "INTEGER"), ("some_bool", "BOOL")])
    try:
        assert c.get_table("test_catalog") == made
        with pytest.raises(errors.ValueError_):
            c.create_table("test_catalog", [("id", "INTEGER")])
    finally:
        c.drop_table("test_catalog")
    with pytest.raises(errors.ValueError_):
        c.get_table("test_catalog")
    with pytest.raises(errors.ValueError_):
        type_of("BLOB")


def test_generator(spark):
    spec = '{"name": "t", "size": 300, "cols": [{"name": "a", "type_id": "INTEGER", "dist": "Serial", "min": 0, "max": 0}, {"name": "b", "type_id": "BIGINT", "dist": "Uniform", "min": -3, "max": 4}]}'
    got = [tuple(r) for r in datagen.generate(spark, spec).collect()]
    assert [a for a, _ in got] == [i % 128 for i in range(300)] and {b for _, b in got} == set(range(-3, 4))
    assert [r[0] for r in datagen.generate(spark, spec, None).collect()] == list(range(300))
    for bad in ("{", '{"size": 1, "cols": [{"name": "a", "type_id": "INTEGER", "dist": "Normal"}]}', '{"size": 1, "cols": [{"name": "a", "type_id": "INTEGER", "dist": "Uniform", "min": 1, "max": 1}]}'):
        with pytest.raises(errors.ParseError):
            datagen.generate(spark, bad)
    assert values(datagen.populate(spark.range(3, 4), "id")) == [(30, 31, 32.0)]
    made = datagen.populate(spark.range(300), "id", 300).collect()
    assert [r["col_a"] for r in made] == [10 * i for i in range(300)]
    assert {r["col_b"] % 10 for r in made} == {1} and len({r["col_b"] for r in made}) <= 100 and len({r["col_c"] for r in made}) > 290
    far = spark.range(9_000_000_000, 9_000_000_003).select(datagen.uniform(F.col("id"), 0, 9).alias("x"))
    assert all(0 <= r["x"] < 9 for r in far.collect())


def test_addresses(spark):
    block, slot = item_pointer(F.col("id"), 4)
    assert values(spark.range(3, 6).select("id", block, slot)) == [(3, 0, 3), (4, 1, 0), (5, 1, 1)]
    got = spark.range(1000).select(hash_bucket(10, F.col("id")).alias("a"), hash_bucket(10, F.col("id"), level=1).alias("b"))
    assert got.distinct().count() == 100


def test_tagged_words(spark):
    w = spark.range(0, 3).select(F.when(F.col("id") == 1, F.col("id")).otherwise(tagged(F.col("id"))).alias("w"))
    assert values(w.select(is_owner(F.col("w")), owner(F.col("w")))) == [(False, None), (True, 0), (True, 2)]


def test_memory_and_replay(spark):
    df = replay([memory.rows(spark, [(1, "a")], "k int, v string"), memory.rows(spark, [], "k int, v string")])
    assert memory.collect(df)[0] == (1, "a") and "|1" in memory.pretty(df) and "|k" in memory.pretty(df.limit(0))
    with pytest.raises(errors.ValueError_):
        replay([])


STATES = [
    # begin_ts, begin_owner, end_ts, end_owner, what a read at 100 by transaction 7 sees, speculatively or not
    (50, None, None, None, "visible", False), (100, None, None, None, "invisible", False), (101, None, None, None, "invisible", False),
    (50, None, 100, None, "deleted", False), (50, None, 101, None, "visible", False), (50, None, 99, None, "deleted", False),
    (None, 7, None, None, "visible", False), (None, 1, None, None, "invisible", False), (None, 2, None, None, "visible", True),
    (None, 3, None, None, "visible", False), (None, 4, None, None, "invisible", False), (None, 5, None, None, "invisible", False),
    (50, None, None, 7, "deleted", False), (50, None, None, 1, "visible", False), (50, None, None, 2, "deleted", True),
    (50, None, None, 3, "deleted", False), (50, None, None, 4, "visible", False), (50, None, None, 5, "deleted", False),
    (50, None, None, 6, "visible", False), (None, 99, None, None, "invisible", False),
]


def test_visibility(spark):
    tx = memory.rows(spark, [(7, "processing", 90), (1, "processing", 10), (2, "preparing", 20), (3, "committed", 30), (4, "aborted", 40), (5, "committed", 100), (6, "preparing", 200)], "tx bigint, state string, ts bigint")
    versions = memory.rows(spark, [(i, *s[:4]) for i, s in enumerate(STATES)], "rid bigint, begin_ts bigint, begin_owner bigint, end_ts bigint, end_owner bigint")
    got = {r["rid"]: (r["visibility"], r["speculative"]) for r in mvcc.visibility(versions, tx, 100, 7).collect()}
    assert got == {i: s[4:] for i, s in enumerate(STATES)}


def test_snapshot_bounds(spark):
    v = memory.rows(spark, [(1, 1, 5), (2, 5, None), (3, 5, 5), (4, None, 9)], "rid int, begin_ts int, end_ts int")
    at = lambda t: [r["rid"] for r in mvcc.snapshot(v, F.lit(t)).orderBy("rid").collect()]
    assert at(1) == [] and at(2) == [1] and at(5) == [] and at(6) == [2]
    assert [r["s"] for r in v.orderBy("rid").select(mvcc.classify(F.lit(6), F.col("begin_ts"), F.col("end_ts")).alias("s")).collect()] == ["deleted", "visible", "deleted", "invisible"]


def test_commit_validation(spark):
    versions = memory.rows(spark, [(1, 10, None, None), (2, 10, 20, None), (3, 10, None, 7), (4, 30, None, None), (5, None, None, 8)], "rid int, begin_ts int, end_ts int, owner int")
    rw = [(1, 15, 1), (1, 15, 2), (2, 25, 2), (7, 15, 3), (8, 15, 3), (9, 15, 4), (10, 10, 1), (11, 20, 2), (12, 5, 99), (8, 15, 5)]
    got = dict(values(mvcc.validate_commits(memory.rows(spark, rw, "tx int, commit_id int, rid int"), versions)))
    assert got == {1: True, 2: False, 7: True, 8: False, 9: False, 10: True, 11: True, 12: False}


def test_access_sets(spark):
    ops = [(1, 1, "read", 1), (1, 1, "update", 2), (1, 2, "insert", 3), (1, 2, "delete", 4), (1, 3, "delete", 5), (1, 3, "read", 6), (2, 1, "read", 1), (2, 2, "insert", 2), (2, 2, "update", 3), (2, 3, "update", 4), (2, 3, "delete", 5)]
    got = values(mvcc.access_sets(memory.rows(spark, ops, "tx int, rid int, op string, seq int")))
    assert got == [(1, 1, "update", True), (1, 2, "insert_delete", True), (1, 3, "delete", False), (2, 1, "read", True), (2, 2, "insert", True), (2, 3, "delete", True)]


def test_install(spark):
    versions = memory.rows(spark, [(1, "a", 1, 5), (1, "b", 5, None), (2, "c", 1, None), (3, "d", 1, None), (5, "z", 1, None)], "rid int, value string, begin_ts int, end_ts int")
    writes = [(1, "update", "B", 10), (1, "update", "BB", 12), (2, "delete", None, 11), (3, "read", None, 9), (4, "insert", "new", 10), (6, "insert_delete", "gone", 10), (4, "delete", None, 13)]
    got = mvcc.install(versions, memory.rows(spark, writes, "rid int, access string, value string, commit_ts int"))
    want = [(1, "a", 1, 5), (1, "b", 5, 10), (1, "B", 10, 12), (1, "BB", 12, None), (2, "c", 1, 11), (3, "d", 1, None), (4, "new", 10, 13), (5, "z", 1, None)]
    memory.assert_same_rows(got, memory.rows(spark, want, got.schema))
    assert values(mvcc.snapshot(got, F.lit(11)).select("rid", "value")) == [(1, "B"), (3, "d"), (4, "new"), (5, "z")]


def test_cascading_abort(spark):
    edges = [(t, d) for t in range(11, 100) for d in range(10)]
    gone = mvcc.cascading_abort(memory.rows(spark, edges, "tx bigint, depends_on bigint"), memory.rows(spark, [(9,)], "tx bigint"))
    assert [r[0] for r in gone.orderBy("tx").collect()] == [9, *range(11, 100)]

    def check(pairs, aborted):
        want, todo, by = set(aborted), list(aborted), {}
        for t, d in pairs:
            by.setdefault(d, []).append(t)
        while todo:
            for t in by.get(todo.pop(), []):
                if t not in want:
                    want.add(t)
                    todo.append(t)
        got = mvcc.cascading_abort(memory.rows(spark, pairs, "tx bigint, depends_on bigint"), memory.rows(spark, [(x,) for x in aborted], "tx bigint"))
        assert [r[0] for r in got.orderBy("tx").collect()] == sorted(want)

    for n in (1, 99, 100, 1000):
        check([(i + 1, i) for i in range(n)], [0])
    check([(i + 1, i) for i in range(1000)] + [(2000 + i, i) for i in range(0, 1000, 7)], [500])
    check([(i, (i + 1) % 9) for i in range(9)] + [(20 + i, i) for i in range(9)] + [(40 + i, 41 + i) for i in range(50)] + [(90, 40)], [3])
    check([(i, (i + 1) % 9) for i in range(9)] + [(20, 3)], [77])
    check([(i, i + d) for i in range(12) for d in (1, 2)] + [(3, 3), (3, 3)], [13])
    rng = random.Random(4)
    for _ in range(3):
        check([(rng.randrange(60), rng.randrange(60)) for _ in range(70)], [rng.randrange(60) for _ in range(2)])
    cycle = memory.rows(spark, [(1, 2), (2, 3), (3, 1), (5, 4)], "tx bigint, depends_on bigint")
    assert values(mvcc.cascading_abort(cycle, memory.rows(spark, [(1,)], "tx bigint"))) == [(1,), (2,), (3,)]
    assert values(mvcc.cascading_abort(cycle, memory.rows(spark, [], "tx bigint"))) == []


def test_locks_and_levels():
    assert mvcc.shared_lock("read_committed", "growing", False) is True
    assert mvcc.shared_lock("read_uncommitted", "growing", False) == "abort"
    assert mvcc.shared_lock("repeatable_read", "shrinking", False) == "abort"
    assert mvcc.shared_lock("repeatable_read", "shrinking", True) is True
    assert mvcc.read_timestamp("read_committed", 1, 2) == 2 and mvcc.read_timestamp("serializable", 1, 2) == 1
    assert mvcc.read_timestamp("read_uncommitted", 1, 2) is None
    for f in (lambda: mvcc.shared_lock("x", "", False), lambda: mvcc.read_timestamp("x", 1, 2)):
        with pytest.raises(errors.ConfigError):
            f()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scratch_tables_go(spark):
    from pathlib import Path

    from brindle.session import materialize, scratch, shared_folder

    def names():
        return {p.name for p in Path(shared_folder(spark).removeprefix("file://")).iterdir()}

    old = materialize(spark.range(3))
    before = names()
    with scratch() as keep:
        materialize(spark.range(1), "gone")
        kept = keep(materialize(spark.range(2), "kept"))
    assert kept.count() == 2 and old.count() == 3
    assert [n.split("-")[0] for n in names() - before] == ["kept"]
