import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, size string, taken int, target string"


def fill(sizes, weights=(5, 2, 1), epochs=3):
    """Water-filling in rounds, exactly."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        level = Fraction(left, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if w[s] * level > epochs * sizes[s]]
        if not over:
            return {s: held.get(s, w[s] * level) for s in names}
        held |= {s: epochs * sizes[s] for s in over}


def place(doc_id, text):
    name = hashlib.md5((text or "").encode()).hexdigest() if doc_id is None else doc_id
    return hashlib.md5(f"17:{name}".encode()).hexdigest()


def brute(rows, whole_documents=False):
    size = [len((t or "").split()) for _, _, t in rows]
    sizes = {}
    for (_, s, _), n in zip(rows, size, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    goal, out = fill(sizes), []
    for s in sizes:
        whole = min(int(goal[s] // sizes[s]), 3) if sizes[s] else 0
        rest = int(goal[s] + Fraction(1, 2)) - whole * sizes[s]
        units = {}
        for i, (d, t, _) in enumerate(rows):
            if t == s:
                units.setdefault(place(d, rows[i][2]), []).append(i)
        for h in sorted(units):
            unit = sum(size[i] for i in units[h])
            part = min(max(rest, 0), unit)
            if whole_documents:
                part = unit if 2 * part >= unit else 0
            rest -= unit
            for i in units[h]:
                out.append((rows[i][0], size[i], sizes[s], round(float(goal[s]), 6), whole * size[i] + (size[i] * part // unit if unit else 0)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, s, t, "x", 1, "y") for d, s, t in rows], SCHEMA)


def run(spark, rows):
    got = mixing.mixed_sizes(mixing.sized(frame(spark, rows)))
    return sorted(((a, b, c, round(t, 6), n) for a, b, c, t, n in (tuple(r) for r in got.collect())), key=repr)


def test_against_rounds(spark):
    rng = random.Random(1)
    for shares in ([1, 1, 1, 1], [50, 1, 1, 1, 2, 9], [1, 30, 3, 3, 3, 1, 1, 12]):
        rows = [(i, f"s{j}", "w " * rng.randrange(0, 60)) for i in range(200) for j in [rng.choices(range(len(shares)), shares)[0]]]
        got = run(spark, rows)
        assert got == brute(rows)
        by = {}
        for _, n, source_size, target, taken in got:
            by.setdefault((source_size, target), [0])[0] += taken
            assert taken <= 3 * n
        assert all(abs(t - x[0]) <= 1 for (_, t), x in by.items())


def test_odd_rows(spark):
    rows = [(1, "a", "x y z"), (1, "a", "x y z"), (2, "a", None), (3, "b", ""), (4, None, "p q"), (None, "c", "r s t u"), (None, "c", "r"), (None, "c", "r"), (None, "c", None), (5, "é", "w " * 4000), (6, "d", "w " * 50000), (7, "", "one")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_wordless(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a", ""), (2, "b", None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_documents_of_the_mix(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 5 and i % 3}", " ".join(f"t{rng.randrange(99)}" for _ in range(rng.randrange(1, 40)))) for i in range(120)] + [(500, "s0", " \n a  b ")]
    df = frame(spark, rows)
    want = {}
    for d, _, _, _, taken in brute(rows, True):
        want[d] = want.get(d, 0) + taken
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    text, got = {d: t for d, _, t in rows}, {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert text[r["doc_id"]] == r["text"] and (r["size"], r["taken"], r["target"]) == ("x", 1, "y")
    assert got == {d: n for d, n in want.items() if n}
    again = mixing.mixed_documents(df.repartition(7))
    assert sorted(out.collect()) == sorted(again.collect())


@pytest.mark.parametrize("weights,epochs", [((1,), 1), ((3, 1), 2)])
def test_other_weights(spark, weights, epochs):
    totals = spark.createDataFrame([("a", 10), ("b", 100), (None, 7)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(totals, weights, epochs).collect()}
    want = fill({"a": 10, "b": 100, None: 7}, weights, epochs)
    assert got == pytest.approx({k: float(v) for k, v in want.items()})
    assert totals.filter(F.col("source") == "a").count() == 1
