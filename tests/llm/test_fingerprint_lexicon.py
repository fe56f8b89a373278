"""The lexicon's band holds exactly the terms it should."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from skyloom.llm import fingerprints


def test_lexicon_is_exactly_the_band(spark):
    low = inspect.signature(fingerprints.fingerprint_documents).parameters["low"].default
    texts = [f"every u{i} v{i} w{i} x{i} y{i} z{i} r{i // 3} s{i // 3}" for i in range(2001)]  # r and s: three of 2001
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    lexicon = fingerprints.build_lexicon(rows, "text", low, 0.1)
    terms = rows.select(F.explode(F.split("text", " ")).alias("t")).distinct()
    held = {r.t for r in terms.where(lexicon.holds(F.xxhash64("t"))).collect()}
    assert held == {f"{k}{i}" for k in "rs" for i in range(667)}
    assert lexicon.size == len(held)


def test_table_finds_its_hashes():
    hashes = [0, 5, -7 << 33, *[k * 0x9E3779B97F4A7C15 % (1 << 63) for k in range(1, 3000)]]
    table, log2 = fingerprints._cuckoo(hashes)
    mask = (1 << log2) - 1
    assert all(h in (table[h & mask], table[(h >> 32) & mask]) for h in hashes)
    assert fingerprints._cuckoo([7])[0][0] != 0  # a hash of 0 is not taken for stored
