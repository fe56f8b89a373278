"""Document fingerprints by I-Match over randomised subsets of a lexicon.

The lexicon holds the terms whose document frequency lies in a band, that is,
whose inverse document frequency is neither too low nor too high.  Frequencies
are counted over all documents.  A document's distinct lexicon terms are sorted,
and each of several random subsets of the lexicon hashes those it contains.  The
fingerprint is the list of these hashes, each after its subset's number; the
likeness of two fingerprints is the share of equal hashes among the subsets that
either document reaches.  Subsets of
several densities serve short and long documents alike.

Only DataFrame functions run here.  The lexicon's size is bounded by the band
(at most mean distinct terms / ``low``), so it travels as a table of the terms'
64-bit hashes, in which each hash has two places: membership is exact.

The next document in descending order of the ids is found within groups of rows,
cut at quantiles of (id, hash of the text), so that neither outlying nor repeated
ids crowd one group.  A text is fingerprinted once, after it has reached its group.

Edge cases: a null text is empty; a text without lexicon terms is fingerprinted
over all its terms, one without terms by its characters, and an empty one by
nothing (two such are alike, any other pair is not); rows with equal ids are ordered by a
hash of their text and null ids come last; a single row's next document is
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import normalised_words

#: At each density, a random part of the lexicon is split into subsets of one term in
#: 2**density; so many subsets at most.  Subset 0 is the whole lexicon.
DENSITIES = (3, 5, 7, 9, 11)
SUBSETS_EACH = 32
#: Rows of a group whose successors are found together, groups there can be at most, and rows seen a group to cut them.
GROUP_ROWS, GROUPS, SEEN = 512, 1 << 14, 16


@dataclass(frozen=True)
class Lexicon:
    """Cuckoo table of the band's term hashes, as a literal array of longs."""

    size: int
    table: Column
    log2: int

    def holds(self, term: Column) -> Column:
        """Whether a term's hash is in the table."""
        slots = (1 << self.log2) - 1

        def stored(slot: Column) -> Column:
            return F.get(self.table, slot.bitwiseAND(slots).cast("int")) == term

        return stored(term) | stored(F.shiftrightunsigned(term, 32))


def _longs(values: list[int]) -> Column:
    """A literal array, folded once when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct terms."""
    return F.transform(F.array_distinct(normalised_words(text)), lambda term: F.xxhash64(term))


def _cuckoo(hashes: list[int]) -> tuple[list[int], int]:
    """Table in which each hash is at the slot of its low or of its high 32 bits, and the logarithm of its size."""
    log2 = max(4, (2 * len(hashes)).bit_length())
    while True:
        table, mask = [None] * (1 << log2), (1 << log2) - 1
        for h in hashes:
            slot = h & mask
            for _ in range(500):
                h, table[slot] = table[slot], h
                if h is None:
                    break
                slot = (h >> 32) & mask if slot == h & mask else h & mask
            else:
                break  # a cycle: a larger table separates it
        else:
            # 0 marks a free slot; only the hash 0 itself looks for it, and only in slot 0
            return [-1 if x is None and i == 0 else x or 0 for i, x in enumerate(table)], log2
        log2 += 1


def build_lexicon(texts: DataFrame, text_col: str, low: float, high: float) -> Lexicon:
    """Terms that at least ``low`` and at most ``high`` of all documents hold."""
    total = texts.count()
    terms = texts.select(F.explode(term_hashes(F.col(text_col))).alias("x_t")).groupBy("x_t").agg(F.count("*").alias("x_df"))
    band = terms.where((F.col("x_df") >= max(2, low * total)) & (F.col("x_df") <= max(2, high * total))).select("x_t")
    hashes = [r.x_t for r in band.collect()]  # bounded by mean distinct terms / low
    table, log2 = _cuckoo(hashes)
    return Lexicon(len(hashes), _longs(table), log2)


def _members(basis: Column, level: int, density: int) -> Column:
    """Terms of a density's subsets as ``subset << 56 | term >>> 8``."""
    index = lambda t: F.shiftrightunsigned(t, 12 * level).bitwiseAND((1 << density) - 1)
    own = F.filter(basis, lambda t: index(t) < SUBSETS_EACH) if 1 << density > SUBSETS_EACH else basis
    return F.transform(own, lambda t: F.shiftleft(index(t) + (1 + level * SUBSETS_EACH), 56).bitwiseOR(F.shiftrightunsigned(t, 8)))


def _entry(subset: Column, hash_: Column) -> Column:
    return F.shiftleft(subset.cast("long"), 24).bitwiseOR(hash_.bitwiseAND(0xFFFFFF))


def _hash_subsets(sorted_members: Column) -> Column:
    """``subset << 24 | hash`` of each subset, folding its sorted terms into one hash."""
    none = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("h"), F.array().cast("array<bigint>").alias("out"))

    def fold(state: Column, member: Column) -> Column:
        subset = F.shiftrightunsigned(member, 56)
        done = F.when(state["s"] < 0, state["out"]).otherwise(F.concat(state["out"], F.array(_entry(state["s"], state["h"]))))
        following = F.struct(subset.alias("s"), F.xxhash64(member).alias("h"), done.alias("out"))
        return F.when(state["s"] == subset, F.struct(state["s"].alias("s"), F.xxhash64(state["h"], member).alias("h"), state["out"].alias("out"))).otherwise(following)

    return F.aggregate(sorted_members, none, fold, lambda state: F.when(state["s"] < 0, state["out"]).otherwise(F.concat(state["out"], F.array(_entry(state["s"], state["h"])))))


def with_signature(rows: DataFrame, text_col: str, name: str, lexicon: Lexicon) -> DataFrame:
    """``rows`` with the fingerprint of ``text_col`` as ``name array<bigint>``: one entry for each subset it reaches."""
    columns = rows.columns
    rows = rows.withColumn("x_terms", term_hashes(F.col(text_col)))
    rows = rows.withColumn("x_band", F.filter("x_terms", lexicon.holds))
    whole = F.when(F.length(text_col) > 0, F.array(F.xxhash64(text_col))).otherwise(F.array().cast("array<bigint>"))
    basis = F.when(F.size("x_band") > 0, F.col("x_band")).when(F.size("x_terms") > 0, F.col("x_terms")).otherwise(whole)
    rows = rows.withColumn("x_basis", F.array_sort(basis))
    members = F.concat(*[_members(F.col("x_basis"), level, density) for level, density in enumerate(DENSITIES)])
    every = F.when(F.size("x_basis") > 0, F.array(_entry(F.lit(0), F.xxhash64("x_basis")))).otherwise(F.array().cast("array<bigint>"))
    return rows.select(*columns, F.concat(every, _hash_subsets(F.array_sort(members))).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among the subsets that either fingerprint reaches; 1 if neither reaches any."""
    subsets = lambda x: F.transform(x, lambda e: F.shiftright(e, 24))
    reached = F.size(F.array_union(subsets(a), subsets(b)))
    return F.when(reached > 0, F.size(F.array_intersect(a, b)) / reached).otherwise(1.0)


def _hex(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _upper_bound(ids: list[int], ties: list[int], key: Column, tie: Column) -> Column:
    """How many of the sorted pairs are not above ``(key, tie)``: a binary search in literal arrays."""
    if not ids:
        return F.lit(0)
    all_ids, all_ties = _longs(ids), _longs(ties)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ids).bit_length()))])

    def widen(at: Column, step: Column) -> Column:
        last = at + step - 1
        low_id, low_tie = F.get(all_ids, last), F.get(all_ties, last)
        # beyond the end both are null, and the search stays
        return F.when((low_id < key) | ((low_id == key) & (low_tie <= tie)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), widen)


def with_next(rows: DataFrame, id_col: str, text_col: str, derive: Callable[[DataFrame], DataFrame], derived: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``derive(rows)`` with ``text_col`` and the column ``derived`` of the next row in descending order of the id, as ``next_*``.

    Groups are cut at quantiles of (id, hash of the text), read off a sample of at
    most ``SEEN * GROUPS`` keys.  Each row goes to its group, is derived from there
    once, and a window finds its successor; only a group's last row looks at the
    first row of the next group that is not empty.  The driver sees one key a group.
    """
    spark = rows.sparkSession
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    least = -(1 << 63)
    # null ids come after all others: their ties are the negative ones
    tie = F.when(F.col(id_col).isNull(), hashed.bitwiseOR(F.lit(least))).otherwise(hashed.bitwiseAND(F.lit((1 << 63) - 1)))
    keyed = rows.withColumn("x_key", F.coalesce(F.col(id_col), F.lit(least))).withColumn("x_tie", tie)
    groups = min(GROUPS, -(-rows.count() // group_rows))
    cuts: list[tuple[int, int]] = []
    if groups > 1:
        every = max(1, rows.count() // (SEEN * groups))
        seen = sorted((r.x_key, r.x_tie) for r in keyed.where(F.pmod(F.xxhash64("x_key", "x_tie"), F.lit(every)) == 0).select("x_key", "x_tie").collect())
        cuts = sorted({seen[k * len(seen) // groups] for k in range(1, groups)}) if seen else []
    placed = keyed.withColumn("x_group", _upper_bound([c[0] for c in cuts], [c[1] for c in cuts], F.col("x_key"), F.col("x_tie")))
    heads = placed.groupBy("x_group").agg(F.max(F.struct("x_key", "x_tie")).alias("x_head")).collect()  # ``GROUPS`` rows at most
    heads = sorted(((r.x_group, r.x_head.x_key, r.x_head.x_tie) for r in heads), reverse=True)
    before = [heads[k - 1][0] for k in range(len(heads))]
    followed = spark.createDataFrame([(*h, b) for h, b in zip(heads, before, strict=True)], "x_group int, x_key long, x_tie long, x_before int")
    first = placed.join(F.broadcast(followed), ["x_group", "x_key", "x_tie"]).dropDuplicates(["x_group"])
    first = derive(first).select(F.col("x_before").alias("x_group"), F.struct(text_col, derived).alias("x_first"))
    own = derive(placed.repartition("x_group"))
    window = Window.partitionBy("x_group").orderBy(F.col("x_key").desc(), F.col("x_tie").desc())
    led = own.withColumn("x_lead", F.lead(F.struct(text_col, derived)).over(window)).join(first, "x_group", "left")
    following = F.coalesce("x_lead", "x_first")
    return led.select(*rows.columns, derived, following[text_col].alias(f"next_{text_col}"), following[derived].alias(f"next_{derived}"))


def fingerprint_documents(
    spark: SparkSession,
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    low: float = 0.001,
    high: float = 0.1,
) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likenesses.

    The edited text's last half is the beginning of the next document.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("x_id"), F.coalesce(F.col(text_col), F.lit("")).alias("x_text"))
    lexicon = build_lexicon(rows, "x_text", low, high)
    led = with_next(rows, "x_id", "x_text", lambda part: with_signature(part, "x_text", "x_print", lexicon), "x_print")
    n = F.length("x_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(x_text, 1, length(x_text) - cast(floor(length(x_text) / 2) as int))"), F.expr("substring(next_x_text, 1, cast(floor(length(x_text) / 2) as int))"))
    led = led.select("x_id", n.cast("long").alias("n_chars"), F.when(half > 0, edited).otherwise(F.col("x_text")).alias("x_edited"), "x_print", "next_x_print")
    both = with_signature(led, "x_edited", "x_edited_print", lexicon)
    return both.select(
        F.col("x_id").alias(id_col),
        "n_chars",
        F.sha2(F.col("x_edited").cast("binary"), 256).alias("edited_sha256"),
        _hex(F.col("x_print")).alias("fingerprint"),
        _hex(F.col("x_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("x_print"), F.col("x_edited_print")).alias("near_edited"),
        likeness(F.col("x_print"), F.col("next_x_print")).alias("near_next"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``."""
    return fingerprint_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
