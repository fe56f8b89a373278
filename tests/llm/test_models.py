"""Classifiers and fingerprints: held-out accuracy, edge cases, stability."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.llm import fingerprints, language, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5], held


def test_quality_on_held_out_documents(labelled):
    train, held = labelled
    model = quality.train([r.text for r in train[:1500]], np.array([r.quality for r in train[:1500]]))
    scores = quality.score_texts(model, pa.array([r.text for r in held], pa.large_string()))
    y = np.array([r.quality for r in held])
    assert ((scores >= 0.3) == y).mean() > 0.98
    assert (scores[y == 1] >= 0.3).mean() > 0.99
    edge = quality.score_texts(model, pa.array([None, "", "\n\n", "x" * 200_000], pa.large_string()))
    assert np.isfinite(edge).all() and edge[0] == edge[1]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    emission, transitions = rng.normal(size=6), rng.normal(size=(2, 2))
    good, pairs, log_z = quality.marginals(emission, transitions, np.array([0, 4, 5, 6]))
    weights = {}
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        weights[tuple(y)] = np.exp(sum(e for e, s in zip(emission[:4], y, strict=True) if s) + sum(transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
    total = sum(weights.values())
    assert np.isclose(log_z[0], np.log(total))
    for i in range(4):
        assert np.isclose(good[i], sum(w for y, w in weights.items() if y[i]) / total)
    assert np.isclose(good[4], 1 / (1 + np.exp(-emission[4])))
    assert np.isclose(pairs.sum(), 3)


def test_single_kind_of_label():
    model = quality.train(["a", "b"], np.array([1, 1]))
    assert quality.score_texts(model, pa.array(["a", None], pa.large_string())).tolist() == [0.5, 0.5]
    chain = toxicity.train(["a"], np.array([[1, 0]]))
    assert chain.probabilities(pa.array(["idiot", None], pa.large_string())).tolist() == [[0, 0]] * 2


def test_toxicity_on_held_out_documents(labelled):
    train, held = labelled
    chosen = [r for r in train if r.toxic][:1200] + [r for r in train if not r.toxic][:1200]
    chain = toxicity.train([r.text for r in chosen], np.array([[r.quality, r.toxic] for r in chosen]))
    p = chain.probabilities(pa.array([r.text for r in held], pa.large_string()))[:, -1]
    y = np.array([r.toxic for r in held])
    # every held-out row counts, junk (which keeps the label of the text it replaced) included: 0.93 and 0.99 when written
    assert (p[y == 1] >= 0.5).mean() > 0.9
    assert (p[y == 0] < 0.5).mean() > 0.985
    assert len(chain.links) == len(toxicity.CHAIN)
    edge = chain.probabilities(pa.array([None, "", "... !"], pa.large_string()))
    assert (edge < 0.5).all()


def test_language_on_held_out_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 200").select("doc_id", "text", "lang").limit(3000).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    chosen = [r for lang in ("de", "en", "es", "fr") for r in [r for r in train if r.lang == lang][:150]]
    net = language.train([r.text for r in chosen], [r.lang for r in chosen], steps=600)
    best, p = language.predict(net, net.pair_tables(), pa.array([r.text for r in held], pa.large_string()))
    assert np.mean([net.languages[b] == r.lang for b, r in zip(best, held, strict=True)]) > 0.95
    assert ((p > 0) & (p <= 1)).all()


def test_windows_cover_whole_texts():
    data = np.frombuffer(b"a" * 600 + b"b" * 3, np.uint8)
    grid, size, owner = language.windows(data, np.array([0, 600, 600, 603]))
    assert size.tolist() == [256, 256, 88, 0, 3] and owner.tolist() == [0, 0, 0, 1, 2]
    assert sum(bytes(g[:n]) == bytes([g[0]]) * n for g, n in zip(grid, size, strict=True)) == 5


def test_undetermined_language(spark):
    net = language.train(["der die das und"] * 3 + ["the of and to"] * 3, ["de"] * 3 + ["en"] * 3, steps=60)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "the of and")], "doc_id long, text string")
    out = {r.doc_id: r.lang_pred for r in language.identify(rows, net).collect()}
    assert out == {1: "und", 2: "und", 3: "und", 4: "en"}


def test_fold_is_the_crc_of_the_id_text(spark):
    from skyloom.llm.sampling import fold

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_fingerprints_of_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "GROUP_ROWS", 2)
    texts = {1: "one two three four five six", 2: "one two three four five six", 7: None, 8: "", 9: "!!! ???", 40: "one two ten", 41: "é" * 5001, 99: "three four seven " * 50}
    rows = spark.createDataFrame([(i, t, 1, "a") for i, t in texts.items()], "doc_id long, text string, x_id int, x_group string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark, rows, high=1.0).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[1].fingerprint == out[2].fingerprint and out[7].fingerprint == out[8].fingerprint
    assert len({out[i].fingerprint for i in (1, 7, 9, 40, 41, 99)}) == 6
    assert out[2].near_next == 1.0 and out[8].near_next == 1.0 and out[9].near_next == 0.0
    assert fingerprints.fingerprint_documents(spark, rows.where("false")).count() == 0
    assert fingerprints.fingerprint_documents(spark, rows.where("doc_id = 40")).first().near_next == 1.0


def test_edited_texts_are_nearer_than_unrelated_ones(spark):
    out = fingerprints.op5_document_fingerprints(spark, "/root/testdata/sf0.001")
    nearer, n = out.agg(F.count_if(F.col("near_edited") > F.col("near_next")), F.count("*")).first()
    assert nearer > 0.9 * n


@pytest.mark.parametrize("kind", ["empty", "null", "repeated", "unmatched"])
def test_models_of_unusual_tables(spark, kind):
    """Empty tables, null columns, repeated rows, labels without documents; extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, x_id string, x_text int, score string"
    rows = {"empty": [], "null": [(None, None, None, None, None, None)] * 3, "repeated": [(1, "a b\nc", "en", "q", 1, "s")] * 4 + [(2, "x" * 300_000, "de", "q", 1, "s")], "unmatched": [(9, "alone", "en", "q", 1, "s")]}[kind]
    labels = {"empty": [], "null": [(None, None, None), (1, None, None)], "repeated": [(1, 1, 0)] * 3 + [(2, 0, 1)], "unmatched": [(5, 1, 1), (6, 0, 0)]}[kind]
    docs = spark.createDataFrame(rows, schema)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, known)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    toxic = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(toxic) == len(rows) and all(0 <= r.p_toxic <= 1 for r in toxic)
    named = language.identify(docs, language.fit(docs)).collect()
    assert len(named) == len(rows) and all(0 <= r.score <= 1 for r in named)
    assert all(r.lang_pred == "und" for r in named) or kind in ("repeated", "unmatched")


def test_samples_of_each_group(spark):
    from skyloom.llm import sampling

    rows = spark.range(5000).selectExpr("id as k", "if(id % 100 = 0, 'rare', 'common') as g")
    picked = sampling.bounded_each(rows, "k", "g", 200)
    by = {g: [k for k, x in picked if x == g] for g in ("rare", "common")}
    assert len(by["rare"]) == 50 and len(set(by["common"])) == 200
    assert sorted(picked) == sorted(sampling.bounded_each(rows.repartition(7), "k", "g", 200))
