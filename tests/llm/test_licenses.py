import random
import re

import pytest

from brindle.llm import licenses


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "" if c not in licenses.IGNORED)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates=licenses.TEMPLATES):
    out = []
    for d, t in rows:
        mine = plain(t)
        for name, x in templates.items():
            want = set(plain(x))
            hit = want & set(mine)
            if len(hit) >= 0.75 * len(want):
                out.append((d, name, len(hit), len(want), min(mine.index(h) for h in hit)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, license string, word int")
    return sorted((tuple(r) for r in licenses.licensed(df).collect()), key=repr)


def filler(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def test_whole_and_changed_texts(spark):
    rng = random.Random(1)
    rows = []
    for text in licenses.TEMPLATES.values():
        for _ in range(6):
            w = text.split()
            for _ in range(rng.randrange(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.3:
                w = w[rng.randrange(0, 1 + len(w) // 8) :]
            body = " ".join(w)
            rows.append((len(rows), filler(rng, rng.randrange(0, 80)) + "\n" + (body.upper() if rng.random() < 0.3 else body) + "  " + filler(rng, rng.randrange(0, 80))))
    rows += [(len(rows) + i, filler(rng, 200)) for i in range(20)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 60


def test_odd_rows(spark):
    mit = licenses.TEMPLATES["MIT-notice"]
    rows = [(1, None), (2, ""), (3, "four words are few"), (4, mit), (4, mit), (None, mit), (5, f"{mit}\n{mit}"), (6, "word " * 60000 + mit), (7, ' \t"Released... under (the) MIT License"')]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_templates_need_a_shingle(spark):
    with pytest.raises(ValueError):
        licenses.licensed(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), {"short": "two words"})


def test_fragments(spark):
    """Three quarters of a template in pieces of three shingles each, which no band is certain to find."""
    rng = random.Random(9)
    templates = {f"t{i}": filler(rng, 5000).replace("w", f"t{i}x") for i in range(3)}
    templates = {k: " ".join(f"{w}{j}" for j, w in enumerate(t.split()[:200])) for k, t in templates.items()}
    rows = []
    for name, text in templates.items():
        w = text.split()
        for copy in range(100):
            # a shingle is left out after each three: its text is there only as overlapping pieces
            pieces = [" ".join(w[i : i + 7]) for i in range(copy % 4, len(w) - 6, 4)]
            rows.append((len(rows), f" {name}gap{copy} ".join(pieces)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in licenses.licensed(df, templates).collect()), key=repr)
    want = brute(rows, templates)
    assert len(want) >= 150 and len(got) >= 0.999 * len(want) and set(got) <= set(want)


def plan_of(spark, templates=None):
    plans = []
    held, licenses.materialize = licenses.materialize, lambda df, name: plans.append((name, df)) or held(df, name)
    try:
        licenses.licensed(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), templates)
    finally:
        licenses.materialize = held
    return {name: df._jdf.queryExecution().executedPlan().toString() for name, df in plans}


def test_no_python_in_the_plan(spark):
    plans = plan_of(spark)
    assert set(plans) == {"items", "keys", "hits", "licenses"} and "concat_ws" not in plans["hits"]
    assert not any("Python" in p or "Arrow" in p for p in plans.values())
    assert "hashpartitioning" not in plans["hits"] and "BroadcastHashJoin" in plans["hits"] and "lambda" not in plans["hits"]


def test_the_plan_does_not_grow_with_the_library(spark):
    rng = random.Random(3)
    many = {f"made-{i}": filler(rng, 60) for i in range(500)}
    few = plan_of(spark, {"made": many["made-0"]})
    assert abs(len(plan_of(spark, many)["hits"]) - len(few["hits"])) < 200
    df = spark.createDataFrame([(i, f"x {many[f'made-{i}']} y") for i in range(0, 500, 7)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.licensed(df, many).collect()}
    assert got == {(i, f"made-{i}") for i in range(0, 500, 7)}
