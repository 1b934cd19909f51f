"""The stages against a plain repetition of what each of them decides."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from brindle.llm import language, quality
from brindle.session import materialize, read_table
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_dedup import brute as brute_groups
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = read_table(spark, small, "documents")
    junk = spark.createDataFrame([(10**6, "1234 5678 !!!", None, "src1", 3), (10**6 + 1, None, None, None, 3), (10**6 + 2, "", "en", "src2", 0)], docs.schema)
    docs = materialize(docs.unionByName(junk).withColumn("score", F.lit("mine")).withColumn("size", F.lit(-1)))
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], small)))
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert all(r["score"] == "mine" and r["size"] == -1 for r in stages[4].select("score", "size").collect())


def test_language(spark, stages):
    lang, score = language.language_of(F.col("text"), language.train(stages[0]))
    want = stages[0].select("doc_id", "text", lang.alias("l"), score.alias("p")).filter((F.col("l") != "und") & (F.col("p") >= cp.LEAST_LANGUAGE_SCORE))
    assert pairs(stages[1]) == pairs(want)
    gone = {r["doc_id"] for r in stages[0].join(stages[1], "doc_id", "left_anti").collect()}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= gone and len(gone) <= 5


def test_quality(spark, small, stages):
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, small, "labels").collect()}
    kept = {d for d, _ in pairs(stages[2])}
    before = {d for d, _ in pairs(stages[1])}
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in kept for d in good) / len(good) > 0.95
    assert sum(d not in kept for d in bad) / len(bad) > 0.6
    assert kept <= before and quality.train(stages[1], read_table(spark, small, "labels")) is not None


def test_near_duplicates(stages):
    rows = pairs(stages[2])
    kept = {d for d, _, _, k in brute_groups(rows) if k}
    assert sorted(d for d, _ in pairs(stages[3])) == sorted(kept)


def test_mix(stages):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in stages[3].collect()]
    want = {d: n for d, _, _, _, n in brute_mix(rows, True) if n}
    got = {}
    for d, t in pairs(stages[4]):
        got[d] = got.get(d, 0) + len(t.split())
    assert got == want


def test_packing(stages):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in stages[4].collect()]
    got = stages[5].collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    want = {}
    for d, _, t in rows:
        want[d] = want.get(d, 0) + len(t.split())
    assert total == want
    assert check([], [], 2048, 4) == {}
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r["doc_id"])
    assert all(len(set(d)) == len(d) for d in bins.values())


def test_run_gives_the_last_stage(spark, small):
    docs = read_table(spark, small, "documents")
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small))
    assert sorted(map(tuple, cp.run(spark, small).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, small):
    docs = read_table(spark, small, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small))
    assert docs.collect() == []
