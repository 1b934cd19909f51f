import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import text as tx
from brindle.llm.sketch import bands, sketches

TEXTS = ["", None, " ", "a", "A b", "a  b\tc\nd e", "x" * 5000, "é É ß a", "one two three four five six", "one two three four five six ", " one  two three four five six", "a b c d e " * 300]


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_shingles(text, k=5):
    w = plain_words(text)
    return [tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("block", [3, 16, 1 << 18])
def test_words_and_shingles(monkeypatch, block):
    monkeypatch.setattr(tx, "BLOCK", block)
    rng = random.Random(block)
    texts = TEXTS + ["".join(rng.choice("ab É\t\nZ") for _ in range(rng.randrange(60))) for _ in range(200)]
    data, offsets = tx.utf8(pa.array(texts))
    assert tx.word_counts(data, offsets).tolist() == [len(plain_words(t)) for t in texts]
    hashes, at = tx.words(data, offsets)
    names = {}
    for i, t in enumerate(texts):
        for w, h in zip(plain_words(t), hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    sh, at = tx.shingles(hashes, at, 5)
    names = {}
    for i, t in enumerate(texts):
        for w, h in zip(plain_shingles(t), sh[at[i] : at[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    _, at = tx.distinct(sh, at)
    assert np.diff(at).tolist() == [len(set(plain_shingles(t))) for t in texts]


def test_words_that_polynomials_mix_up():
    """Words of a and b by the parity of bits, and the same with letters swapped, agree in any polynomial modulo 2^64."""
    for n in (64, 512, 1024, 2048, 4096):
        word = "".join("ab"[i.bit_count() & 1] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        hashes, _ = tx.words(*tx.utf8(pa.array([word, other, word[8:] + word[:8], word.upper()])))
        assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[3]
    far = ["x" * 5000 + a + "x" * 5000 + b for a in ("", "x" * 7 + "y", "y" + "x" * 7) for b in ("", "z")]
    assert len(set(tx.words(*tx.utf8(pa.array(far)))[0].tolist())) == 6


def test_sliced_and_null_columns():
    column = pa.array(["a b", None, "c", "d e f"])[1:]
    assert tx.word_counts(*tx.utf8(column)).tolist() == [0, 1, 3]
    assert tx.word_counts(*tx.utf8(pa.chunked_array([["a b"], ["c"]]))).tolist() == [2, 1]
    assert tx.word_counts(*tx.utf8(pa.array([], pa.string()))).tolist() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 7, 100, 3000)]
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for share in (0.9, 0.75, 0.5, 0.1):
        same = int(400 * 2 * share / (1 + share))
        sets += [base, np.concatenate([base[:same], rng.integers(0, 1 << 63, 400 - same).astype(np.uint64)])]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = sketches(np.concatenate(sets), offsets, 128)
    assert (got[0] == 0).all()
    assert all(len(set(got[i].tolist())) >= min(len(sets[i]), 2) for i in range(1, 6))
    for i, share in enumerate((0.9, 0.75, 0.5, 0.1)):
        a, b = got[6 + 2 * i], got[7 + 2 * i]
        assert abs((a == b).mean() - share) < 5 * np.sqrt(share * (1 - share) / 128)
    alone = sketches(sets[3], np.array([0, len(sets[3])]), 128)
    assert (alone[0] == got[3]).all()
    keys = bands(got, 4)
    assert keys.shape == (len(sets), 32) and (keys[6] == keys[8]).all()
