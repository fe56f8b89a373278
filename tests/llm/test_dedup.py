"""Substring, near-duplicate and contamination operators against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, factors, simhash, substrings, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x_rid string, x_key int, x_text string"


def documents(spark, texts, ids=None):
    """Rows with extra columns whose names clash with internal ones."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), "mine", 7, None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Passages shared whole, in part and within a text; junk lines; empties; nulls; repeats; one long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé fgh".replace(" ", ""), k=rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, other = prose(90), prose(70)
    texts = [None, "", " ", "a", passage, passage, "x " + passage[3:] + " tail", prose(200), "A  B\tc " * 60, "\n".join(["same line of junk"] * 40)]
    texts += [prose(rng.randint(1, 60)) + " " + passage + " " + prose(30) for _ in range(12)]
    texts += [prose(20) + other[: rng.randint(150, 400)] + prose(5) for _ in range(8)]
    texts += [prose(3000) + passage + prose(100) + passage, "é" * 700, "€" * 500 + passage]
    return texts


def covered(texts, width):
    """Brute force: bytes of windows that start at two places or more."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - width + 1):
            seen[d[k : k + width]] = seen.get(d[k : k + width], 0) + 1
    out = []
    for d in data:
        marks = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                marks[k : k + width] = b"\1" * width
        out.append((d, marks))
    return out


@pytest.mark.parametrize("hot,piece", [(8000, 1 << 21), (2, 2000)])
def test_suffix_dedup_equals_brute_force(spark, corpus, hot, piece):
    got = {r[0]: tuple(r) for r in substrings.digest(spark, documents(spark, corpus), hot=hot, piece_bytes=piece).collect()}
    for i, (d, marks) in enumerate(covered(corpus, 200)):
        kept = bytes(b for b, m in zip(d, marks, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(marks) if m and (k == 0 or not marks[k - 1]))
        assert got[i] == (i, len(d), sum(marks), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(260))
    rows = documents(spark, [text, text, "short", "short"], [None, None, 4, 4])
    got = sorted((r.n_bytes, r.n_removed) for r in substrings.digest(spark, rows).collect())
    assert got == [(5, 0), (5, 0), (260, 260), (260, 260)]


def test_removed_text_keeps_columns_and_characters(spark, corpus):
    rows = documents(spark, corpus)
    out = substrings.remove_repeats(spark, rows)
    assert out.schema == rows.schema
    marks = covered(corpus, 200)
    for r in out.collect():
        d, m = marks[r.doc_id]
        assert (r.x_rid, r.x_key) == ("mine", 7)
        if corpus[r.doc_id] is None:
            assert r.text is None
            continue
        at, kept = 0, ""
        for c in corpus[r.doc_id]:
            n = len(c.encode())
            kept += "" if all(m[at : at + n]) else c
            at += n
        assert r.text == kept


def test_empty_tables(spark):
    none = documents(spark, [])
    assert substrings.digest(spark, none).count() == 0
    assert factors.digest(spark, none).count() == 0
    assert simhash.near_duplicates(spark, none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(spark, none, bench).count() == 0
    assert substrings.remove_repeats(spark, none).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 50)), 0).astype(np.uint8)
        raw = t.tobytes()
        expected = sorted(range(len(t)), key=lambda i: raw[i:])
        sa = suffix.suffix_array(t, 256)
        assert sa.tolist() == expected
        assert suffix.suffix_array(t.astype(np.int64) * 70_000, 70_000 * 6).tolist() == expected
        assert (suffix.permuted_common_prefixes(t.astype(np.uint32), sa, 20)[0] == suffix.permuted_common_prefixes(t, sa, 20)[0]).all()
        common, _ = suffix.permuted_common_prefixes(t, sa, 20, block=4)
        for a, b in zip(expected, expected[1:], strict=False):
            n = 0
            while raw[a + n : a + n + 1] == raw[b + n : b + n + 1] != b"":
                n += 1
            assert common[b] == min(n, 20)


@pytest.mark.parametrize("hot", [8000, 2])
def test_earlier_windows_equal_brute_force(spark, corpus, hot):
    ids = [3 * i % 37 for i in range(len(corpus))]  # the order of the ids is not that of the rows
    got = {r[0]: tuple(r) for r in factors.digest(spark, documents(spark, corpus, ids), hot=hot).collect()}
    words = {i: (t or "").encode().split() for i, t in zip(ids, corpus, strict=True)}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (i, len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_words_whose_polynomial_hashes_collide_are_told_apart(spark):
    """Thue-Morse words of 1,024 bytes have one polynomial hash modulo 2**64, whatever its base."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([word] * 60), " ".join([other] * 60), " ".join([word] * 55)]
    got = {r.doc_id: r.n_removed for r in factors.digest(spark, documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 55}


def test_factors_are_the_longest():
    """Every position's factor is the longest that starts in a block of smaller age."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = rng.integers(1, 12, 8)
        symbols = np.concatenate([np.append(rng.integers(2, 4, n), 1) for n in sizes])
        stops = np.cumsum(sizes + 1) - 1
        end = np.repeat(stops, sizes + 1)
        age = np.repeat(rng.integers(0, 5, len(sizes)), sizes + 1)
        got = factors.longest_factors(symbols, end, age)
        for i in range(len(symbols)):
            best = 0
            for j in np.flatnonzero(age < age[i]):
                n = 0
                while i + n < end[i] and j + n < end[j] and symbols[i + n] == symbols[j + n]:
                    n += 1
                best = max(best, n)
            assert got[i] == best


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, corpus):
    texts = corpus + [corpus[7] + " x", corpus[7] + " y z", corpus[7].upper()]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark, documents(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root = [low if r in (root[a], root[b]) else r for r in root]
                    changed = True
    assert got == {i: (f"{p:016x}", root[i]) for i, p in enumerate(prints)}


def groups(values, pairs):
    root = {int(v): int(v) for v in values}
    for a, b in pairs:
        x, y = root[a], root[b]
        if x != y:
            for k, v in root.items():
                if v == max(x, y):
                    root[k] = min(x, y)
    return root


def test_long_posting_lists_link_alike(spark):
    """Lists that are keyed anew, down to half bytes, give the links of all pairs."""
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 16, 500, dtype=np.uint64), rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.uint64(7) ^ np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    classes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "x_fp long")
    expected = groups(values, [(int(a), int(b)) for k, a in enumerate(values) for b in values[k + 1 :] if int(a ^ b).bit_count() <= 2])
    for long_list in (512, 4):
        links = simhash.index_links(simhash.Scratch(spark, "test"), classes, 2, long_list).collect()
        assert groups(values, [(r.u % (1 << 64), r.v % (1 << 64)) for r in links]) == expected


def test_the_tally_rejects_pairs_of_a_list():
    """Entries of a list share four bytes; pairs that share fewer than six go before any bit is compared."""
    masks = simhash.finer(0, 2)
    assert len(masks) == 6 and all(m.bit_count() == 32 for m in masks)
    base = 0x1122334455667788
    values = np.array([base, base ^ 0x0101, base ^ 0x010101, base ^ 0x03 << 56], np.uint64)
    tally = (values.view(np.uint8).reshape(4, 8)[1:] == values[:1].view(np.uint8)).sum(axis=1)
    assert tally.tolist() == [6, 5, 7]
    assert simhash._spanning(values, 2) == [(0, 1), (0, 3), (1, 2)]


def test_contamination_rules(spark):
    thirteen = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(10, thirteen + " w13"), (2, "Short Item"), (3, None), (4, "..."), (None, "lost"), (5, thirteen)], "item_id long, text string")
    long = " ".join(f"u{i}" for i in range(400))
    texts = [None, "", "!!", f"a {thirteen.upper()}, b", f"x {thirteen} w13", "short-ITEM", long + " short item", long[:60] + " short item short item", "w1 w2"]
    out = {r.doc_id: r for r in decontaminate.find_contamination(spark, documents(spark, texts), bench).collect()}
    assert [out[i].n_words for i in range(9)] == [0, 0, 0, 15, 15, 2, 402, 22, 2]
    assert [out[i].n_hit for i in range(9)] == [0, 0, 0, 13, 14, 2, 2, 4, 0]
    assert [out[i]["items"] for i in (3, 4, 5, 6, 8)] == [["10", "5"], ["10", "5"], ["2"], ["2"], []]
    assert [out[i].contaminated for i in range(9)] == [False, False, False, True, True, True, False, True, False]
    kept = decontaminate.drop_contaminated(spark, documents(spark, texts), bench)
    assert kept.columns == SCHEMA.replace("long", "").replace("string", "").replace("int", "").replace(" ", "").split(",")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6, 8]


def test_contamination_without_broadcast(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = documents(spark, ["alpha beta gamma delta", "alpha gamma"])
    small = decontaminate.find_contamination(spark, rows, bench)
    large = decontaminate.find_contamination(spark, rows, bench, broadcast_windows=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.where(F.col("contaminated")).count() == 1


def test_contamination_with_many_windows(spark):
    """More windows than are broadcast: only likely windows of the documents become rows."""
    item = lambda k: " ".join(f"q{k}x{j}" for j in range(13))
    bench = spark.range(210_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(0, 12), j -> concat('q', id, 'x', j))) as text")
    prose = " ".join(f"u{k}" for k in range(5000))
    rows = documents(spark, [prose, f"{prose} {item(7)} end", f"{item(209_999)} {item(3)}", None])
    found = decontaminate.find_contamination(spark, rows, bench)
    out = {r.doc_id: r for r in found.collect()}
    assert [out[k].n_hit for k in range(4)] == [0, 13, 26, 0]
    assert [out[k]["items"] for k in range(4)] == [[], ["7"], ["209999", "3"], []]


def test_spans_of_many_hits(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta")], "item_id long, text string")
    text = "alpha beta gamma x delta y alpha beta z " * 3000
    (one,) = decontaminate.find_contamination(spark, documents(spark, [text]), bench).collect()
    assert one.n_hit == 18_000 and len(one.spans) == 9000
    assert [tuple(s) for s in one.spans[:4]] == [(1, 3), (5, 5), (7, 8), (10, 12)]


@pytest.mark.parametrize(("operator", "sql"), [(substrings, substrings.OP1_SQL), (factors, factors.OP8_SQL)], ids=["op1", "op8"])
def test_digests_match_sql(spark, corpus, operator, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t in enumerate(corpus)])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    found = operator.digest(spark, documents(spark, corpus)).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(result.fetchall())
