"""Quality classification from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as tx
from brindle.llm.sample import fold
from brindle.session import bound_batches

#: Buckets of 3-grams of characters, and as many of words and pairs of words, as a power of two.
GRAM_BITS = 11
#: Random directions that a sampled text's n-grams are reduced to before the driver gets them, and how many
#: principal ones of these the model uses.
DIRECTIONS, COMPONENTS = 256, 8
#: Names of the features besides n-grams, in order.
SURFACE = ("log words", "letters", "upper", "digits", "blanks", "line ends", "stops", "marks", "symbols", "other bytes", "word length", "distinct words", "repeated neighbours", "byte entropy")
BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 64

_CLASS = np.full(256, 6)
_CLASS[[*range(97, 123), *range(65, 91)]] = 0
_CLASS[128:] = 7
_CLASS[48:58] = 1
_CLASS[[0x20, 9, 11, 12, 13]] = 2
_CLASS[10] = 3
_CLASS[[ord(c) for c in ".,"]] = 4
_CLASS[[ord(c) for c in "!?;:'\"-()"]] = 5
_ONE = np.eye(8)[_CLASS]
#: Shapes of characters: letters are alike but for their case, digits are, and blanks are. So a language that
#: the trusted texts lack isn't taken for bad, as it would be by its words.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[[0x20, 9, 11, 12, 13]] = 32


def surface(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of kinds of bytes, sizes and repetition of whole texts, a row each."""
    n = len(offsets) - 1
    out = np.zeros((n, len(SURFACE)))
    if not n:
        return out
    counts = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]).astype(float)
    size = np.maximum(counts.sum(axis=1), 1)
    kinds = counts @ _ONE / size[:, None]
    w = np.diff(at)
    words = np.maximum(w, 1)
    owner = np.repeat(np.arange(n), w)
    p = counts / size[:, None]
    out[:, 0] = np.log1p(w)
    out[:, 1] = kinds[:, 0]
    out[:, 2] = counts[:, 65:91].sum(axis=1) / size
    out[:, 3:10] = kinds[:, 1:]
    out[:, 10] = (size - counts[:, tx.SPACE].sum(axis=1)) / words
    out[:, 11] = np.diff(tx.distinct(hashes, at)[1]) / words
    if len(hashes) > 1:
        out[:, 12] = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / words
    out[:, 13] = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1)
    squeeze = [2, 3, 5, 7, 8, 12]  # small shares tell as much as large ones
    out[:, squeeze] = np.log1p(50 * out[:, squeeze])
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of shapes in each text: of 3 characters, and of words and pairs of words.

    The scalar product of two rows is the Bhattacharyya coefficient of what the texts consist of.
    """
    n, size = len(offsets) - 1, 1 << GRAM_BITS
    shape = _SHAPE[data]
    hashes, at = tx.words(shape, offsets)
    code = shape.astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = row[:-2] == row[2:]
    gram = (code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:])[inside]
    place = row[:-2][inside] * size + (gram * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS))
    owner = np.repeat(np.arange(n), np.diff(at))
    pair = owner[1:] == owner[:-1]
    both = np.concatenate([hashes, tx.mix(hashes[:-1] * tx.U(3) + hashes[1:])[pair]]) >> tx.U(64 - GRAM_BITS)
    other = np.concatenate([owner, owner[1:][pair]]) * size + both.astype(np.int64)
    parts = [np.bincount(x, minlength=n * size).reshape(n, size).astype(np.float32) for x in (place, other)]
    return np.hstack([np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in parts])


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with their n-grams and surface features, of bounded size."""
    for a, b in tx.groups(offsets, BYTES_AT_ONCE):
        for i in range(a, b, ROWS_AT_ONCE):
            j = min(b, i + ROWS_AT_ONCE)
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            hashes, at = tx.words(part, own)
            yield i, j, grams(part, own), surface(part, own, hashes, at)


def directions() -> np.ndarray:
    """Fixed random directions of n-grams."""
    return np.random.default_rng(23).standard_normal((2 << GRAM_BITS, DIRECTIONS)).astype(np.float32) / np.float32(np.sqrt(DIRECTIONS))


@dataclass
class Model:
    """A network with one hidden layer on standardized inputs: components of n-grams by ``basis``, and surface features."""

    basis: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, grams: np.ndarray, surface: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is better text."""
        return _sigmoid(self.margin(np.hstack([grams @ self.basis, surface])))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 8, steps: int = 600, batch: int = 1024, rate: float = 0.01, decay: float = 0.03, seed: int = 3, naive: bool = False) -> Model:
    """Minimizes the non-negative unbiased risk (Kiryo and others, 2017).

    The risk is prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]) with the sigmoid loss
    l(z) = 1 / (1 + exp(z)), which is bounded, so that a slightly wrong prior doesn't hold all margins
    near 0. Where the second part falls below 0 in a batch, its ascent step is taken instead, as the
    paper does. ``naive`` tells positives from unlabelled rows by the logistic loss, which the estimate
    of the prior needs.
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    d = p.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        x = np.vstack([p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]])
        h = np.tanh(x @ w[0] + w[1])
        s = _sigmoid(h @ w[2] + w[3][0])
        sp, su = s[:batch], s[batch:]
        if naive:
            dg = np.concatenate([sp - 1, su]) / batch
        else:
            dp, du = sp * (1 - sp) / batch, su * (1 - su) / batch
            if su.mean() >= prior * sp.mean():
                dg = np.concatenate([-2 * prior * dp, du])
            else:
                dg = np.concatenate([prior * dp, -du])
        dh = np.outer(dg, w[2]) * (1 - h * h)
        grads = [x.T @ dh + decay * w[0], dh.sum(axis=0), h.T @ dg + decay * w[2], np.array([dg.sum()])]
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            w[i] = w[i] - rate * (0.3 + 0.7 * (1 - step / steps)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(np.zeros((0, 0)), mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3, splits: int = 11) -> float:
    """The share of positives among unlabelled rows, by best-bin estimation (Garg and others, 2021).

    A classifier of positives against unlabelled rows is trained on one half of each. On the other
    halves, the share of unlabelled rows above a threshold over that of positives bounds the prior from
    above wherever the threshold is; the ratio where it is least, with a margin for chance, is the
    estimate. The mean over several splits varies less, which matters where positives are few.
    """
    found = []
    for split in range(splits):
        rng = np.random.default_rng([seed, split])
        p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
        a, b = len(p) // 2, len(u) // 2
        model = fit_risk(p[:a], u[:b], 0.5, naive=True, seed=seed + split, hidden=24, decay=1e-4)
        sp, su = np.sort(model.margin(p[a:])), np.sort(model.margin(u[b:]))
        slack = np.sqrt(np.log(40) / 2 / len(sp)) + np.sqrt(np.log(40) / 2 / len(su))
        best, least = 1.0, np.inf
        for c in np.quantile(sp, np.linspace(0, 0.99, 100)):
            qp, qu = 1 - np.searchsorted(sp, c) / len(sp), 1 - np.searchsorted(su, c) / len(su)
            if qp > 0 and (qu + slack) / qp < least:
                least, best = (qu + slack) / qp, qu / qp
        found.append(min(best, 1.0))
    return float(np.clip(np.mean(found), 0.05, 0.99))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reduce = directions()
    for batch in batches:
        for i, j, g, x in blocks(*tx.utf8(batch.column("text"))):
            rows = [r.tobytes() for r in np.hstack([g @ reduce, x.astype(np.float32)])]
            yield pa.RecordBatch.from_arrays([batch.column("trusted")[i:j], pa.array(rows, pa.binary())], ["trusted", "x"])


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Learns from rows of reduced n-grams and surface features, in this order.

    The principal components of the n-grams of all these texts, which need no labels, are the inputs, with
    the surface features; the prior is estimated, and then the risk is minimized.
    """
    both = np.vstack([positive, unlabelled])[:, :DIRECTIONS]
    value, vector = np.linalg.eigh(np.cov(both.T))
    basis = vector[:, ::-1][:, :COMPONENTS]
    p, u = (np.hstack([x[:, :DIRECTIONS] @ basis, x[:, DIRECTIONS:]]) for x in (positive, unlabelled))
    model = fit_risk(p, u, estimate_prior(p, u))
    model.basis = (directions() @ basis).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, seed: int = 9) -> Model | None:
    """Learns from at most about ``most`` trusted positives and as many unlabelled texts.

    Positives are the documents whose quality is 1, in rows with crc32(doc_id) mod 3 other than 1;
    unlabelled ones are any documents. The share of positives among the latter is estimated, not
    given. The executors reduce each whole text to ``DIRECTIONS`` and some numbers, 1 KB, before the driver
    gets it.
    """
    bound_batches(docs.sparkSession)
    good = labels.filter((F.col("quality") == 1) & (fold(F.col("doc_id"), 3) != 1)).select(F.col("doc_id").alias("_good")).distinct()
    place = lambda c, s: F.pmod(F.xxhash64(F.lit(s), c), F.lit(1 << 30)) / F.lit(1 << 30)
    n_good, n_docs = good.count(), docs.count()
    if not n_good or not n_docs:
        return None
    chosen = good.filter(place("_good", seed) < min(1.0, most / n_good))
    rows = docs.select("doc_id", "text")
    trusted = rows.join(chosen, F.col("doc_id") == F.col("_good"), "left_semi").select(F.lit(True).alias("trusted"), "text")
    web = rows.filter(place(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")), seed + 1) < min(1.0, most / n_docs)).select(F.lit(False).alias("trusted"), "text")
    got = sorted((r["trusted"], bytes(r["x"])) for r in trusted.unionAll(web).mapInArrow(_sampled, "trusted boolean, x binary").collect())
    p, u = (np.array([np.frombuffer(x, np.float32) for t, x in got if t is kind], np.float64) for kind in (True, False))
    if len(p) < 4 or len(u) < 4:
        return None
    return fit(p, u)


def quality_scorer(model: Model | None):
    """A column function of a whole text: its score, 0 to 1.

    Defined results: a null text is scored as an empty one, which has a score like any other; without
    any trusted positive nothing can be learned, and all texts have 0.5.
    """

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(text), 0.5))
        out = [model.scores(g, x) for _, _, g, x in blocks(*tx.utf8(text))]
        return pa.array(np.concatenate([np.zeros(0), *out]).astype(np.float64))

    return score


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for all documents, learned from those not held out.

    The inputs are hashed n-grams of shapes (see ``grams``) of the whole text, by their principal components,
    and a few shares of kinds of bytes; nothing else of a row is looked at.

    Defined results: null and empty texts have the score of a text without n-grams; a text of any length is
    scored whole; equal texts have equal scores, so repeated rows do; a score of exactly 0.5 counts as 1; a
    null doc_id is not held out and never a label; a doc_id with several labels is trusted if one of them is
    1; without documents there are no rows, and without trusted positives all scores are 0.5; other columns
    may have any names.
    """
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), quality_scorer(train(docs, labels))(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
