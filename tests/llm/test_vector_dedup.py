import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import vector_dedup as vd
from brindle.session import scratch

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, class string"


def brute(rows, least=0.93):
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [usable(v, label) for _, v, label in rows]
    x = [np.array(v, np.float32).astype(float) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, n[i], c, c is None or d == c))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], SCHEMA)
    return sorted((tuple(r) for r in vd.near_vectors(df, **options).collect()), key=repr)


@pytest.mark.parametrize("block", [16, 1024])
def test_links_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=24) for _ in range(60)]
    for _ in range(8):
        base = rng.normal(size=24)
        rows += [base + rng.normal(size=24) * rng.uniform(0.02, 0.45) for _ in range(12)]
    rows = [(i, x.astype(np.float32).tolist(), int(rng.integers(0, 2))) for i, x in enumerate(rows)]
    assert run(spark, rows, block_rows=block) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (2, [2.0, -0.0, 0.0], 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 0.0], 0), (9, [nan, 1.0, 0.0], 0), (10, [inf, 1.0, 0.0], 0), (None, one, 0), (11, [1.0, 0.0], 0), (0, [1.0, 0.1, 0.0], 0), (12, [-0.0, 1.0, 0.0], 1), (13, [0.0, 1.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert vd.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_parts_of_blocks_and_hot_labels(spark, monkeypatch):
    """One label has nearly all rows, in more parts than one; many near copies of one vector are counted, not sent as pairs."""
    monkeypatch.setattr(vd, "PART_ROWS", 32)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    rows = [(i, (hot + rng.normal(size=16) * (0.05 if i % 3 == 0 else 1.5)).tolist(), 0 if i < 280 else 1) for i in range(300)]
    for block in (64, 4096):
        assert run(spark, rows, block_rows=block) == brute(rows)


def test_calibration_holds_for_pairs_at_the_limit():
    rng = np.random.default_rng(0)
    width, least = vd.calibrate(0.93, 64)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    d = vd.directions(64, 64, 11)
    hits = np.array([vd.collisions((a[i] @ d)[None], (b[i] @ d)[None], width)[0, 0] for i in range(2000)])
    assert hits.min() >= least
    far = vd.collisions(a[:500] @ d, a[500:1000] @ d, width)
    assert (far >= least).mean() < 0.02
    p, q = a[:5] @ d, a[5:30] @ d
    assert (vd.collisions(p, q, width) == (np.abs(p[:, None] - q[None]) <= width).sum(axis=2)).all()


def test_tables_of_buckets(spark):
    """A label of many blocks is searched by tables, one of near copies only as a whole; links are those of all pairs."""
    rng = np.random.default_rng(8)
    spread = [rng.normal(size=24) for _ in range(500)]
    for _ in range(30):
        base = rng.normal(size=24)
        spread += [base + rng.normal(size=24) * rng.uniform(0.02, 0.45) for _ in range(8)]
    near = rng.normal(size=24)
    hot = [near + rng.normal(size=24) * 0.1 for _ in range(200)]
    rows = [(i, x.astype(np.float32).tolist(), label) for i, (x, label) in enumerate([(x, 0) for x in spread] + [(x, 1) for x in hot])]
    rows += [(2000, [1.0, 2.0], 0), (2001, [1.0, 2.01], 0), (2002, [-1.0, 2.0], 0), (2003, [1.0, 0.0], 2)]
    assert run(spark, rows, block_rows=8) == brute(rows)


def test_buckets_are_counted_before_they_are_chosen(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=24)
    held = [(i, 1, 0, rng.normal(size=24).tolist()) for i in range(800)] + [(800 + i, 1, 1, (near + rng.normal(size=24) * 0.02).tolist()) for i in range(800)]
    held = spark.createDataFrame(held, "node bigint, times bigint, label int, vector array<double>")
    sizes = held.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("rows"))
    with scratch():
        keyed, buckets = vd._tables(held, sizes, 0.93, 8, 11)
        lengths = {(r.label, len(r["keys"])) for r in keyed.collect()}
        found = buckets.collect()
    assert lengths == {(0, vd.tables_of(0.93, 7)), (1, 1)}
    assert [(r._table, r._bucket, r.rows) for r in found if r._label == 1] == [(0, 0, 800)]
    assert sum(r.rows**2 for r in found if r._label == 0) < 800**2 / 2


def test_pairs_at_the_limit_share_a_bucket():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    for signs in (5, 9):
        tables = vd.tables_of(0.93, signs)
        batch = pa.RecordBatch.from_pydict({"vector": pa.array([*a.tolist(), *b.tolist()]), "signs": pa.array([signs] * 8000, pa.int32())})
        (out,) = vd._keyed(0.93, 11)([batch])
        keys = np.array(out.column("keys").to_pylist())
        assert keys.shape == (8000, tables)
        shared = keys[:4000] == keys[4000:]
        assert shared.any(axis=1).all()
        assert abs(shared.mean() - (1 - np.arccos(0.93) / np.pi) ** signs) < 0.02
        assert (keys[:2000] == keys[2000:4000]).mean() < 2 * 0.5**signs
