"""Packing, chat rendering and the pipeline."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from skyloom.llm import chat, packing, quality


VOCABULARY = Tokenizer.from_file(packing.default_tokenizer())


@pytest.fixture(scope="module")
def tokenizer():
    return VOCABULARY


def check_packing(rows, texts, tokenizer, size=1024):
    """Every id is placed once, sequences are gapless, checksums agree."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == size or k == 0
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_places_every_token(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "a<|endoftext|>b"), (1003, "naïve 你好 😀  \n\t x" * 700)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    sequences, tokens = check_packing(packing.pack(spark, docs).collect(), texts, tokenizer)
    assert sequences <= 1.02 * -(-tokens // 1024) + 1


PIECES = ["'s", "<|endoftext|>", "<|", " ", "\n", "\u00a0", "\u2003", "\x85", "Ab", "1", "\u00b2", "\u2026", "\t", "\r\n", "'ll", "\u0130", "\u00df", "\x00", "\ufeff", "e\u0301", "\U0001f600"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)))
def test_ranks_give_the_ids_of_the_vocabulary(text):
    text = text.encode("utf-8", "ignore").decode()
    assert list(packing._encoder(packing.default_tokenizer(), packing.default_ranks())(text)) == VOCABULARY.encode(text, add_special_tokens=False).ids


def test_packing_of_nothing_and_of_repeats(spark):
    schema = "doc_id long, text string, x_len int"
    assert packing.pack(spark, spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark, spark.createDataFrame([(1, "a b", 0)] * 3, schema)).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_repeated_rows_spread_over_the_shards(spark):
    rows = packing.pack(spark, spark.createDataFrame([(None, "same text")] * 400, "doc_id long, text string").repartition(3), shard_documents=100).collect()
    shards = [r.sequence_id >> 32 for r in rows]
    assert len(rows) == 400 and max(shards.count(s) for s in set(shards)) < 200


def test_the_vocabulary_alone_gives_the_same_places(spark):
    docs = spark.createDataFrame([(i, "naïve words <|endoftext|> " * i) for i in range(6)], "doc_id long, text string")
    places = [sorted(map(tuple, packing.pack(spark, docs, tokenizer=t).collect())) for t in (None, packing.default_tokenizer())]
    assert places[0] == places[1]


def test_place_minimises_the_sum_of_squares():
    packer = packing.SumOfSquares(10)
    rng = np.random.default_rng(2)
    for length in rng.integers(1, 11, 300).tolist():
        before = packer.counts.copy()
        options = {}
        for gap in [*np.flatnonzero(before).tolist(), 10]:
            if gap >= length:
                after = before.copy()
                if gap < 10:
                    after[gap] -= 1
                if gap > length:
                    after[gap - length] += 1
                options[gap] = int((after**2).sum())
        packer.place(length)
        assert int((packer.counts**2).sum()) == min(options.values())


def test_snapshots_collapse(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, None, None), (6, 0, None, ""), (None, 0, "user", "lost"),
        (7, 0, "user", "hi"), (7, 0, "user", "hi"),
    ]
    rows = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, x_n int")
    out = {r.conv_id: r for r in chat.collapse_and_render(rows).collect()}
    assert {i: (r.n_turns, r.n_copies) for i, r in out.items()} == {2: (3, 2), 4: (2, 1), 5: (1, 1), 6: (1, 1), 7: (2, 1)}
    assert out[4].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    assert chat.collapse_and_render(rows.where("false")).count() == 0


def alike(rows):
    """Brute force: the smallest id of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = sets[a] | sets[b]
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(union):
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    return set(root.values())


def test_pipeline_stages(spark, tokenizer, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            frames[name] = {r.doc_id: r for r in docs.collect()}
    assert set(frames["quality_classifier"]) == good
    first = spark.read.parquet(str(tmp_path / "quality_classifier"))
    assert set(frames["simhash_near_dedup"]) == alike(first.collect())
    cut = frames["suffix_array_dedup"]
    assert set(cut) == set(frames["simhash_near_dedup"]) and all(r.n_chars == len(r.text) for r in cut.values())
    texts = {i: r.text for i, r in frames["benchmark_decontamination"].items()}
    check_packing(docs.collect(), texts, tokenizer)


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
