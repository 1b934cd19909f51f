"""Language and quality: held-out accuracy, odd rows, and what is an input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import language, quality
from brindle.session import read_table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, small):
    return read_table(spark, DATA, "documents")


def test_language_accuracy_on_held_out_rows(spark, docs):
    got = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, low, high = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and right / n > 0.98 and 0 <= low <= high <= 1


def test_language_only_learns_from_its_fold(docs):
    lied = docs.withColumn("lang", F.when(language.fold(F.col("doc_id"), 5) == 0, "xx").otherwise(F.col("lang")))
    assert language.train(docs).weights.tobytes() == language.train(lied).weights.tobytes()


def test_language_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(i, "le chat et le chien " * 3, "fr") for i in range(40, 80)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "123 --- 45", None), (103, "le chien", None), (None, "the dog", None), (103, "le chien", None), (104, "the cat " * 50000, None), (105, "字", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(3))
    got = language.identified(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "fr", "en", "en"]
    assert by[100]["score"] == 0 and by[105]["lang_pred"] in ("en", "fr") and got.count() == len(rows)


def test_language_without_anything_to_learn(spark):
    schema = "doc_id bigint, text string, lang string"
    assert language.identified(spark.createDataFrame([], schema)).collect() == []
    got = language.identified(spark.createDataFrame([(1, "words", None)], schema)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_scores_from_the_full_kernel():
    """With all training texts as landmarks, the batched product gives what kernel ridge regression does by its definition."""
    import pyarrow as pa

    from brindle.llm import text as tx

    rng = np.random.default_rng(3)
    syllables = {"xx": ["ba", "to", "ri"], "yy": ["ke", "shu", "mo"], "zz": ["ba", "mo", "lin"]}
    labels = [c for c in syllables for _ in range(8)]
    texts = ["".join(rng.choice(syllables[c] + [" "]) for _ in range(30)) for c in labels]
    x = language.presence(*tx.utf8(pa.array(texts)))
    model = language.fit(np.packbits(x.astype(bool), axis=1), labels, landmarks=24)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    # ridge with an intercept that isn't penalized, on features whose scalar products are the kernel
    for text in ["batori batori", "shumoke mo", "linba mo linba", "q"]:
        row = np.array([kernel(grams(text), b) for b in sets])
        out = []
        for c in model.classes:
            y = np.where(np.array(labels) == c, 1.0, -1.0)
            
            alpha = np.linalg.lstsq(np.block([[k + 8e-3 * np.eye(24), np.ones((24, 1))], [np.ones((1, 24)), np.zeros((1, 1))]]), np.append(y, 0), rcond=None)[0]
            out.append(row @ alpha[:-1] + alpha[-1])
        e = np.exp(language.SHARPNESS * (np.array(out) - max(out)))
        got = model.scores(language.presence(*tx.utf8(pa.array([text]))))[0]
        assert np.allclose(got, e / e.sum(), atol=0.02)


def test_language_ties(spark):
    """Classes learned from the same texts tie; the first by name is taken, in any order of rows."""
    rows = [(i, f"la {i % 7} le", "bb" if i % 2 else "aa") for i in range(60)] + [(100, "la le", None)] * 2
    for r in (rows, rows[::-1]):
        got = {x["lang_pred"] for x in language.identified(spark.createDataFrame([(i, t, "aa" if n == "aa" else n) for i, t, n in r], "doc_id bigint, text string, lang string")).filter("doc_id = 100").collect()}
        assert len(got) == 1 and got <= {"aa", "bb"}


def test_kernel_counts_common_ngrams():
    import pyarrow as pa

    from brindle.llm import text as tx

    data, offsets = tx.utf8(pa.array(["abcab", "bca", ""]))
    x = language.presence(data, offsets)
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in ("abcab", "bca", "")]
    want = [[len(a & b) for b in grams] for a in grams]
    assert (x @ x.T).astype(int).tolist() == want


def test_quality_on_held_out_rows(spark, docs):
    labels = read_table(spark, DATA, "labels")
    got = quality.classified(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_learns_from_no_negative_and_no_held_out_label(spark, docs):
    labels = read_table(spark, DATA, "labels")
    lied = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 3) == 1, F.lit(1)).otherwise(F.col("quality"))).filter("quality = 1")
    a, b = quality.train(docs, labels), quality.train(docs, lied)
    assert a.w1.tobytes() == b.w1.tobytes() and a.prior == b.prior


def test_prior_is_estimated():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (4000, 5)), rng.normal(3, 1, (4000, 5))
    for prior in (0.3, 0.8):
        n = int(3000 * prior)
        mixed = np.vstack([good[1000 : 1000 + n], bad[: 3000 - n]])
        got = quality.estimate_prior(good[:1000], mixed)
        assert abs(got - prior) < 0.08
        model = quality.fit_risk(good[:1000], mixed, got)
        assert (model.margin(good[-500:]) >= 0).mean() > 0.95 and (model.margin(bad[-500:]) < 0).mean() > 0.9


def test_risk_is_minimized():
    """The fitted network's non-negative risk, computed from its definition, against other networks and a brute-force search."""
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (900, 1)), rng.normal(4, 1, (900, 1))
    p, u = good[:300], np.vstack([good[300:780], bad[:120]])

    def risk(margin):
        loss = lambda z: 1 / (1 + np.exp(z))
        gp, gu = margin(p), margin(u)
        return 0.8 * loss(gp).mean() + max(0.0, loss(-gu).mean() - 0.8 * loss(-gp).mean())

    model = quality.fit_risk(p, u, 0.8, decay=0.0, steps=3000)
    steps = [risk(lambda x, c=c, k=k: k * (c - x[:, 0])) for c in np.linspace(-2, 6, 81) for k in (1, 3, 10, 30)]
    assert risk(model.margin) < min(steps) + 0.02
    z = np.clip((u - model.mean) / model.scale, -6, 6)
    slow = [sum(np.tanh(sum(z[i, k] * model.w1[k, h] for k in range(1)) + model.b1[h]) * model.w2[h] for h in range(len(model.w2))) + model.b2 for i in range(50)]
    assert np.allclose(model.margin(u[:50]), slow)


def test_scores_against_a_plain_count():
    """n-grams, components and scores of texts, counted one by one."""
    import pyarrow as pa

    from brindle.llm import text as tx

    texts = ["The cat 12 sat", "", "a", "été été été | x", "The  the THE"]
    data, offsets = tx.utf8(pa.array(texts))
    (_, _, g, x), *rest = quality.blocks(data, offsets)
    assert not rest and g.shape == (5, 2 << quality.GRAM_BITS) and x.shape == (5, len(quality.SURFACE))

    def count(text):
        out = np.zeros(2 << quality.GRAM_BITS)
        b = [48 if 48 <= c <= 57 else 32 if c in b" \t\n\v\f\r" else 65 if 65 <= c <= 90 else 97 if c >= 128 or 97 <= c <= 122 else c for c in text.encode()]
        for i in range(len(b) - 2):
            out[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 32 - quality.GRAM_BITS] += 1 / (len(b) - 2)
        h = [int(v) for v in tx.words(*tx.utf8(pa.array([bytes(b)])))[0]]
        items = h + [int(tx.mix(np.array([(a * 3 + c) % 2**64], np.uint64))[0]) for a, c in zip(h, h[1:], strict=False)]
        for v in items:
            out[(1 << quality.GRAM_BITS) + (v >> 64 - quality.GRAM_BITS)] += 1 / len(items)
        return np.sqrt(out)

    assert np.allclose(g, [count(t) for t in texts], atol=1e-6)
    rng = np.random.default_rng(0)
    k = quality.COMPONENTS + len(quality.SURFACE)
    model = quality.Model(rng.normal(size=(g.shape[1], quality.COMPONENTS)), rng.normal(size=k), np.ones(k), rng.normal(size=(k, 3)), rng.normal(size=3), rng.normal(size=3), 0.1, 0.5)
    for t, got in zip(texts, model.scores(g, x), strict=True):
        i = texts.index(t)
        z = np.clip(np.concatenate([count(t) @ model.basis, x[i]]) - model.mean, -6, 6)
        assert np.isclose(got, 1 / (1 + np.exp(-(np.tanh(z @ model.w1 + model.b1) @ model.w2 + model.b2))), atol=1e-4)


def test_few_positives_keep_good_texts(spark, docs):
    labels = read_table(spark, DATA, "labels")
    some = labels.filter((F.col("quality") == 1) & (quality.fold(F.col("doc_id"), 3) != 1)).orderBy(F.xxhash64("doc_id")).limit(40)
    score = quality.quality_scorer(quality.train(docs, some))(F.col("text"))
    good = docs.join(labels.filter("quality = 1").join(some, "doc_id", "left_anti"), "doc_id").select((score < 0.5).cast("int").alias("gone"))
    assert good.agg(F.avg("gone")).first()[0] <= 0.03


def test_quality_odd_rows(spark, docs):
    labels = read_table(spark, DATA, "labels")
    more = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, None), (None, "words"), (10**6 + 2, "word " * 60000), (10**6 + 2, "word " * 60000)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more).withColumn("score", F.lit("x"))
    got = quality.classified(both, labels.withColumn("text", F.lit(0)))
    assert got.count() == both.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.classified(more, empty).filter("score = 0.5 and predicted = 1").count() == 6
    assert quality.classified(more.limit(0), labels).collect() == []
