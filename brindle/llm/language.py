"""Language identification by a string kernel on landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as tx
from brindle.llm.sample import fold, per_class
from brindle.session import bound_batches, scratch

#: Buckets that n-grams are hashed to, as a power of two.
BUCKET_BITS = 14
#: Longest n-gram, in bytes of UTF-8; shorter ones count too.
LONGEST = 3
#: Bytes and texts of one presence matrix.
BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 64
#: Sharpens the regression's outputs, which are near 1 and -1, to a probability.
SHARPNESS = 3.0

_ALPHABET = np.arange(256, dtype=np.uint8)
_ALPHABET[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each lower-cased text: 1 for each bucket that one of its n-grams falls into.

    ASCII characters that aren't letters count as blanks. The product of two rows is the
    blended-spectrum presence kernel: the number of n-grams, of all lengths, that both texts have.
    """
    n = len(offsets) - 1
    out = np.zeros((n, 1 << BUCKET_BITS), np.float32)
    code = _ALPHABET[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) << BUCKET_BITS, np.diff(offsets))
    flat, gram = out.ravel(), code
    for size in range(1, LONGEST + 1):
        if size > 1:
            gram = (gram[:-1] << np.uint32(8)) | code[size - 1 :]
        bucket = ((gram ^ np.uint32(size << 28)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
        inside = row[: len(gram)] == row[size - 1 :]
        flat[(row[: len(gram)] + bucket)[inside]] = 1
    return out


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of texts with their presence rows, of bounded size."""
    for a, b in tx.groups(offsets, BYTES_AT_ONCE):
        for i in range(a, b, ROWS_AT_ONCE):
            j = min(b, i + ROWS_AT_ONCE)
            yield i, j, presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _presence_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, x in blocks(*tx.utf8(batch.column("text"))):
            bits = np.packbits(x.astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("lang")[i:j], pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "bits"])


@dataclass
class Model:
    """classes, and for each a weight by bucket and an intercept."""

    classes: list[str]
    weights: np.ndarray
    intercept: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the classes for presence rows."""
        if not self.classes:
            return np.zeros((len(x), 0))
        length = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        g = SHARPNESS * ((x @ self.weights) / length + self.intercept)
        e = np.exp(g - g.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Presence rows of packed bits, each divided by its length."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    return x


def fit(bits: np.ndarray, labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features, from packed presence bits.

    The kernel is normalized: k(x, y) = <x, y> / (|x| |y|). Landmarks L, as many of each class, give
    the features k(x, L) K^(-1/2) with K = k(L, L). As the kernel is a scalar product, a text's output
    x L' K^(-1/2) B / |x| is one product with the precomputed matrix L' K^(-1/2) B. Rows are unpacked
    some at a time, so this takes little memory.
    """
    classes = sorted(set(labels))
    if not classes:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([classes.index(c) for c in labels])
    each = max(1, landmarks // len(classes))
    lm = unpacked(bits[np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(classes))])])
    value, vector = np.linalg.eigh((lm @ lm.T).astype(np.float64))
    keep = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.vstack([unpacked(bits[i : i + ROWS_AT_ONCE]) @ lm.T for i in range(0, len(bits), ROWS_AT_ONCE)]) @ root
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    balance = 1 / np.bincount(y, minlength=len(classes))[y][:, None]  # each class weighs alike
    gram = phi.T @ (phi * balance) + ridge * np.diag([1.0] * (phi.shape[1] - 1) + [0.0])
    beta = np.linalg.lstsq(gram, phi.T @ (target * balance), rcond=None)[0]
    return Model(classes, lm.T @ (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def train(docs: DataFrame, per_class_rows: int = 600, all_rows: int = 12_000, seed: int = 5) -> Model:
    """Learns from at most about ``per_class_rows`` texts of each language and ``all_rows`` in all.

    Only texts with a language, of rows whose crc32(doc_id) mod 5 isn't 0, are used. The executors
    reduce each whole text to one bit a bucket, 2 KB, before the driver gets it.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    with scratch():
        some = per_class(rows, "lang", per_class_rows, all_rows, seed).select("lang", F.lower("text").alias("text"))
        got = sorted((r["lang"], bytes(r["bits"])) for r in some.mapInArrow(_presence_bits, "lang string, bits binary").collect())
    order = np.random.default_rng(seed).permutation(len(got))
    bits = np.frombuffer(b"".join(got[i][1] for i in order), np.uint8).reshape(len(got), -1) if got else np.zeros((0, 1 << BUCKET_BITS >> 3), np.uint8)
    return fit(bits, [got[i][0] for i in order])


def language_scorer(model: Model):
    """A column function of a lower-cased text: a struct of lang and score."""

    @F.arrow_udf("lang string, score double")
    def predict(text: pa.Array) -> pa.Array:
        best, score = [], []
        for _, _, x in blocks(*tx.utf8(text)):
            p = model.scores(x)
            top = p.argmax(axis=1) if len(model.classes) else np.zeros(len(x), int)
            best.append(top)
            score.append(p[np.arange(len(x)), top] if len(model.classes) else np.zeros(len(x)))
        names = pa.array(model.classes or ["und"])
        best = np.concatenate(best) if best else np.zeros(0, int)
        return pa.StructArray.from_arrays([names.take(pa.array(best, pa.int64())), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], ["lang", "score"])

    return predict


def language_of(text: Column, model: Model) -> tuple[Column, Column]:
    """The language of a whole text and its probability.

    Defined results: a text that is null, empty or without a letter is ``und`` with score 0; so is
    every text if the model has learned no class.
    """
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = language_scorer(model)(F.lower(text))
    return F.when(letters, found["lang"]).otherwise("und"), F.when(letters, found["score"]).otherwise(0.0)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for all documents, learned from those not held out.

    Defined results: those of ``language_of``; equal texts have equal results, so repeated rows do; of
    languages with equal scores the first by name is taken; a text of any length is read whole; a null
    doc_id is not held out; an empty table gives no rows; other columns may have any names.
    """
    lang, score = language_of(F.col("text"), train(docs))
    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), lang.alias("lang_pred"), score.alias("score"))
