"""I-Match fingerprints, edited texts and likenesses against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash

from skyloom.llm import fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(value, seed=42):
    """Spark's xxhash64 of a string or a long."""
    data = value.encode() if isinstance(value, str) else (value % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def chained(values, seed=42):
    for v in values:
        seed = xx(v, seed)
    return seed


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys("".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" "))) if low else []


def brute(texts, low, high):
    """Fingerprints of texts by the definition; ``texts`` are the corpus whose frequencies count."""
    counts = {}
    for t in texts:
        for w in {w for w in terms_of(t) if w}:
            counts[w] = counts.get(w, 0) + 1
    n = len(texts)
    band = {w for w, c in counts.items() if max(2, low * n) <= c <= max(2, high * n)}

    def print_of(text):
        terms = [w for w in terms_of(text) if w]
        basis = sorted(signed(xx(w)) for w in ([w for w in terms if w in band] or terms or ([text] if text else [])))
        if not basis:
            return []
        out = [chained(basis) & 0xFFFFFF]
        members = {}
        for level, density in enumerate(fingerprints.DENSITIES):
            for t in basis:
                index = (t % (1 << 64)) >> 12 * level & (1 << density) - 1
                if index < fingerprints.SUBSETS_EACH:
                    members.setdefault(1 + level * fingerprints.SUBSETS_EACH + index, []).append((t % (1 << 64)) >> 8)
        for subset in sorted(members, key=lambda x: signed(x << 56)):  # as signed numbers
            packed = [signed(subset << 56 | t) for t in sorted(members[subset])]
            first = xx(packed[0])
            for m in packed[1:]:
                first = xx(m, xx(signed(first)))
            out.append(subset << 24 | first & 0xFFFFFF)
        return out

    return print_of


def like(a, b):
    reached = {x >> 24 for x in a} | {x >> 24 for x in b}
    return len(set(a) & set(b)) / len(reached) if reached else 1.0


def texts_of(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", None, "...", texts[0], "A-b c", "é" * 5000]


def check(rows, got, low, high):
    order = sorted(rows, key=lambda r: -r[0])
    texts = [t or "" for _, t in order]
    print_of = brute(texts, low, high)
    for k, (i, _) in enumerate(order):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = print_of(own), print_of(edited), print_of(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in a)
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in b)
        assert (r.near_edited, r.near_next) == pytest.approx((like(a, b), like(a, c)))


def test_fingerprints_equal_brute_force(spark):
    rows = [(7 * i % 97, t) for i, t in enumerate(texts_of(60))]
    frame = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, x_group string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark, frame, low=0.05, high=0.3).collect()}
    check(rows, got, 0.05, 0.3)


def test_groups_follow_the_ids_wherever_they_lie(spark, monkeypatch):
    """One outlying id does not gather the others in one group, nor do repeated and null ids."""
    seen = {}
    whole = fingerprints._upper_bound
    monkeypatch.setattr(fingerprints, "_upper_bound", lambda ids, *rest: (seen.setdefault("cuts", ids), whole(ids, *rest))[1])
    rows = [(i, t) for i, t in enumerate(texts_of(90))] + [((1 << 62) + 5, "far away"), (-(1 << 62), "farther")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    derive = lambda part: part.withColumn("x_n", fingerprints.F.length("text"))
    out = {r.doc_id: r.next_text for r in fingerprints.with_next(frame, "doc_id", "text", derive, "x_n", 8).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert out == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    assert len(set(seen["cuts"])) > 5
    same = spark.createDataFrame([(1 if k % 2 else None, f"text {k}") for k in range(60)], "doc_id long, text string")
    out = fingerprints.with_next(same, "doc_id", "text", derive, "x_n", 8).collect()
    assert sorted(r.text for r in out) == sorted(r.next_text for r in out)  # the order is one circle


def test_fingerprints_of_nothing_and_of_one(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprint_documents(spark, spark.createDataFrame([], schema)).count() == 0
    (one,) = fingerprints.fingerprint_documents(spark, spark.createDataFrame([(None, "ab cd")], schema)).collect()
    assert one.doc_id is None and one.near_next == 1.0
