"""The pipeline's near copies come from SimHash fingerprints and an index over their byte positions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from test_nearcopies import brute_kept, edited, rows_of

import corpus_pipeline
from skyloom.llm import nearcopies


def near_pairs(rng, count, size, own):
    """Sets of ``size`` hashes; each pair has ``own`` of its own on either side."""
    sets = []
    for _ in range(count):
        both = rng.integers(0, 1 << 63, size + own, dtype=np.uint64) << np.uint64(1)
        sets += [both[:size], both[own:]]
    return sets


def test_fingerprint_bits_are_majorities():
    rng = np.random.default_rng(3)
    share = []
    for a, b in zip(*[iter(near_pairs(rng, 40, 270, 30))] * 2, strict=True):  # a Jaccard similarity of 0.8
        x, y = (np.frombuffer(nearcopies.positional_bytes(s), np.uint8) for s in (a, b))
        assert len(x) == nearcopies.POSITIONS
        share.append(np.bitwise_count(x ^ y).mean() / 8)
        union = np.frombuffer(nearcopies.positional_bytes(np.concatenate([a, a, b[-30:]])), np.uint8)
        assert np.bitwise_count(x ^ union).mean() / 8 < 0.1  # weights count, which minima ignore
    assert abs(np.mean(share) - np.arccos(8 / 9) / np.pi) < 0.005
    assert nearcopies.positional_bytes(a) == nearcopies.positional_bytes(a[::-1], block=7)


@pytest.mark.parametrize("long", [256, 2])
def test_index_joins_pairs_at_the_threshold(monkeypatch, long):
    monkeypatch.setattr(nearcopies, "LONG", long)
    rng = np.random.default_rng(5)
    sets = near_pairs(rng, 200, 135, 15) + near_pairs(rng, 100, 9, 1)
    n = np.array([len(s) for s in sets])
    prints = np.frombuffer(b"".join(map(nearcopies.positional_bytes, sets)), np.uint8).reshape(-1, nearcopies.POSITIONS)
    keys, few = np.arange(len(sets)), n <= nearcopies.SHORT
    lists = range(nearcopies.LISTS)
    found = np.concatenate([nearcopies._postings(keys, n, prints, lists), nearcopies._postings(keys[few], n[few], prints[few], range(nearcopies.LISTS, 2 * nearcopies.LISTS))])
    found = found[np.lexsort((found["set"], found["n"], found["key"]))]
    joined = {tuple(sorted(p)) for p in nearcopies._join_lists(found, 0.8)}
    assert joined == {(i, i + 1) for i in range(0, len(sets), 2)}


@pytest.mark.parametrize("small", [32, 2])
def test_cluster_links_connect_what_brute_force_connects(monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = []
    for k in range(30):  # a chain of overlapping ranges, and some apart
        at = 8 * k + (60 if k > 20 else 0)
        sets.append(np.sort(base[at : at + 100]))
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    root = list(range(30))
    for a in range(30):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    links = nearcopies._cluster_links(sets, 0.8)
    assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in links)
    assert len(links) == 30 - len(set(root)) == 28


def test_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 300)
    rng = random.Random(13)
    base = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(120)) for _ in range(3)]
    texts = base + [edited(rng, t, n) for t in base for n in (1, 1, 2, 2, 3, 9)]
    for _ in range(9):
        texts.append(edited(rng, texts[-1], 1))
    out = corpus_pipeline.keep_distinct(spark, rows_of(spark, texts, range(len(texts))), "")
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(texts)
