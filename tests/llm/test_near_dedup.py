import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.llm.near_dedup import keep_one, near_duplicates
from brindle.session import shared_folder
from tests.llm.test_text import plain_shingles

SCHEMA = "doc_id bigint, text string, raw int, node string, n_shingles string"


def brute(rows):
    sets = [set(plain_shingles(t)) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None] if sets[i] else [d] * (d is not None)
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 120)))) for i in range(60)]
    for _ in range(6):
        base = words(rng, rng.randrange(20, 200))
        rows += [(0, edited(rng, base, rng.randrange(0, 8))) for _ in range(rng.randrange(2, 25))]
    crowd = words(rng, 150)  # near the limit in many ways
    rows += [(0, edited(rng, crowd, rng.randrange(0, 7))) for _ in range(120)]
    chain = words(rng, 100)
    for _ in range(12):
        rows.append((0, " ".join(chain)))
        chain = chain[3:] + words(rng, 3)
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text), (3, text.upper()), (9, None), (8, ""), (7, " \n"), (None, text), (None, "alone in the world"), (None, None), (2, "a b"), (1, "A  b"), (4, "b a"), (4, "b a"), (6, "long " * 30000), (10, "long " * 40000)]
    assert run(spark, rows) == brute(rows)


def test_tables_are_released(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    names = lambda: {p.name for p in folder.iterdir()}
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, text + f" {i % 3}" + " x y z" * (i % 5)) for i in range(50)], "doc_id bigint, text string")
    df.groupBy().count().collect()
    before = names() if folder.exists() else set()
    near_duplicates(df).collect()
    assert sorted(n.split("-")[0] for n in names() - before) == ["ids", "names"]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("extra", ["kept", "component_id", "text2"])
def test_keep_one(spark, extra):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text + " x"), (3, text + " x"), (3, text), (4, text), (9, None), (9, None), (8, "other words here"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(extra, F.lit("z"))
    out = keep_one(df)
    assert out.columns == ["doc_id", "text", extra]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    near = [r for r in got if r[0] in (3, 4, 5, None)]
    assert len(near) == 1 and near[0][0] == 3
    assert [r[0] for r in got if r[0] in (8, 9)] == [8, 9, 9]
