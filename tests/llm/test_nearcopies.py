"""The pipeline's near copies against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from skyloom.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x_row long"


def rows_of(spark, texts, ids):
    return spark.createDataFrame([(i, t, None, "s", None, 7) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}


def brute_kept(texts):
    """Index of the first text of each group of near copies."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def edited(rng, text, n):
    words = text.split()
    for p in rng.sample(range(len(words)), n):
        words[p] = f"e{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("small", [32, 2])
def test_stage_drops_what_brute_force_finds(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(12)]
    texts = [None, "", " ", "a b", "A  b", "a b c", *base]
    texts += [edited(rng, t, n) for t in base for n in (1, 2, 3, 4, 6, 20)]
    chain = base[0]
    for _ in range(6):  # each is a near copy of the one before, not of the first
        chain = edited(rng, chain, 3)
        texts.append(chain)
    out = corpus_pipeline.keep_distinct(spark, rows_of(spark, texts, range(len(texts))), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(texts)


def test_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(2)
    one, other, third = (" ".join(f"w{rng.randint(0, 3000)}" for _ in range(80)) for _ in range(3))
    texts = [one, one, other, third, third, third, other + " x"]
    ids = [1, 5, 5, None, None, 9, 4]
    out = corpus_pipeline.keep_distinct(spark, rows_of(spark, texts, ids), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, one), (4, other + " x"), (9, third)])


def test_tallies_keep_every_pair_at_the_threshold():
    """Short sets are tallied exactly, long ones by positional bytes; mixed pairs by what both bring."""
    rng = np.random.default_rng(2)
    sets = []
    for size in (40, 480, 512, 530, 900):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for changed in (0, 0.05, 0.1, 0.3, 0.6):
            own = base.copy()
            own[: int(size * changed)] = rng.integers(0, 1 << 63, int(size * changed), dtype=np.uint64)
            sets.append(np.unique(own[: size - int(rng.integers(0, 8))]))
    n = np.array([len(s) for s in sets])
    values = [np.unique(s.astype(np.uint32)).tobytes() if len(s) <= nearcopies.EXACT else b"" for s in sets]
    signs = [nearcopies.positional_bytes(s) if len(s) >= 0.8 * nearcopies.EXACT else b"" for s in sets]
    every = [(i, np.arange(i + 1, len(sets))) for i in range(len(sets))]
    found = {(int(a), int(b)) for i, j in nearcopies._alike(iter(every), n, values, signs, 0.8) for a, b in zip(i, j, strict=True)}
    jaccard = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    assert found >= {p for p, x in jaccard.items() if x >= 0.8}
    assert not {p for p in found if jaccard[p] < 0.65}
