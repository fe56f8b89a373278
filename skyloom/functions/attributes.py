"""References between variables in attributes, kept consistent after selection and renaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the metadata convention.
ONE_NAME = ("bounds", "climatology", "geometry", "grid_mapping")
NAME_LISTS = ("ancillary_variables", "coordinates", "node_coordinates")
KEYED_NAMES = ("cell_measures", "formula_terms")


def _words(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != "")


def _renamed(word: Column, renames: Mapping[str, str]) -> Column:
    out = word
    for old, new in renames.items():
        out = F.when(word == old, F.lit(new)).otherwise(out)
    return out


def reference(kind: str, value: Column, available: Sequence[str], renames: Mapping[str, str]) -> Column:
    """The value of a reference attribute with known names only; NULL if nothing remains.

    ``kind`` is ``one`` (exactly one name), ``list`` (each name once) or ``keyed``
    (``label: name`` pairs; any other shape is dropped).
    """
    known = F.array(*map(F.lit, available)) if available else F.array().cast("array<string>")
    words = _words(value)
    names = F.transform(words, lambda w: _renamed(w, renames))
    if kind == "one":
        return F.when((F.size(words) == 1) & F.array_contains(known, F.get(names, F.lit(0))), F.get(names, F.lit(0)))
    if kind == "list":
        kept = F.array_distinct(F.filter(names, lambda w: F.array_contains(known, w)))
        return F.when(F.size(kept) > 0, F.array_join(kept, " "))
    if kind != "keyed":
        raise ValueError(f"no references of kind {kind!r}")
    labels = F.filter(words, lambda w, i: i % 2 == 0)
    targets = F.filter(names, lambda w, i: i % 2 == 1)
    pairs = F.filter(F.zip_with(labels, targets, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: F.array_contains(known, p["b"]))
    regular = (F.size(words) % 2 == 0) & F.forall(labels, lambda w: w.endswith(":"))
    return F.when(regular & (F.size(pairs) > 0), F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])), " "))


def sanitised(attrs: Column, available: Sequence[str], renames: Mapping[str, str] | None = None) -> Column:
    """An attribute map whose references name available variables; others are dropped."""
    kinds = {**dict.fromkeys(ONE_NAME, "one"), **dict.fromkeys(NAME_LISTS, "list"), **dict.fromkeys(KEYED_NAMES, "keyed")}
    entries = [F.struct(F.lit(key).alias("key"), reference(kind, F.element_at(attrs, F.lit(key)), available, renames or {}).alias("value")) for key, kind in kinds.items()]
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return F.map_concat(F.map_filter(attrs, lambda k, _: ~k.isin(*kinds)), F.map_from_entries(kept))


def swath_corner(text: Column, name: str) -> Column:
    """Two numbers of a corner from structural metadata; packed degrees are divided by a million."""
    pair = F.regexp_extract(text, name + r"\s*=\s*\(\s*([-+0-9.eE]+\s*,\s*[-+0-9.eE]+)\s*\)", 1)
    numbers = F.transform(F.split(pair, ","), lambda v: F.trim(v).try_cast("double"))
    packed = F.exists(numbers, lambda v: F.abs(v) > 1000)
    return F.transform(numbers, lambda v: F.when(packed, v / 1e6).otherwise(v))
