"""What the driver holds and starts for a training and for connected components."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import components, quality, textops
from skyloom.llm.scratch import Scratch


def lines(rng, n):
    return "\n".join(" ".join(f"w{rng.randint(0, 400)}" for _ in range(12)) for _ in range(n))


def test_training_holds_the_hashes_of_one_piece():
    rng = random.Random(5)
    texts = ["", *(lines(rng, 60) for _ in range(1200)), lines(rng, 3500)]
    size = sum(map(len, texts))
    assert size > 3_500_000
    quality.train(["a", "b"], np.arange(2), rounds=1)  # what is imported late
    textops._powers.cache_clear()
    tracemalloc.start()
    model = quality.train(texts, np.arange(len(texts)) % 2, rounds=2)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert np.isfinite(model.weights).all()
    assert held < 24_000_000  # tables of powers for one piece stay
    assert peak < 160_000_000


def test_features_of_pieces_are_those_of_the_whole():
    rng = random.Random(6)
    texts = ["", "\n\n", "é! A\nb#", *(lines(rng, rng.randint(1, 9)) for _ in range(40)), ""]
    for got, whole in zip(quality._features_of(texts, 700), quality.line_features(*textops.utf8(pa.array(texts, pa.large_string()))), strict=True):
        assert got.dtype == whole.dtype and (got == whole).all()


def brute_roots(pairs):
    root = {x: x for pair in pairs for x in pair}
    while True:
        before = dict(root)
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
        if root == before:
            return {x: r for x, r in root.items() if x != r}


@pytest.mark.parametrize("one_task", [None, 60, 0])
def test_components_in_few_jobs(spark, monkeypatch, one_task):
    if one_task is not None:
        monkeypatch.setattr(components, "ONE_TASK", one_task, raising=False)
    rng = random.Random(7)
    chain = [(k, k + 1) for k in range(-40, 0)]
    pairs = [*chain, *((rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)), (7, 7), (1 << 62, -(1 << 62)), (-20, -20), (5, 900), (900, 800)]
    rng.shuffle(pairs)
    scratch = Scratch(spark, "test")
    edges = scratch.write(spark.createDataFrame([*pairs, (3, None), (None, None)], "u long, v long"), "pairs")
    spark.sparkContext.setJobGroup(f"components {one_task}", "")
    try:
        got = {r.node: r.root for r in components.components(scratch, edges).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {one_task}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute_roots([p for p in pairs if p[0] != p[1]])
    assert one_task is not None or jobs <= 8


def test_components_of_nothing(spark):
    scratch = Scratch(spark, "test")
    assert components.components(scratch, scratch.write(spark.createDataFrame([(4, 4), (3, None)], "u long, v long"), "pairs")).collect() == []
