"""Toxicity by a classifier chain over the presence of words and stems.

The label columns of ``labels`` form a chain, ``toxic`` last: each link is a
logistic model over the words (and word beginnings) of the whole text plus the
probabilities of all earlier links.  While training, the earlier probabilities of
a document come from models that did not see it (out-of-fold), so later links do
not learn to trust overfitted inputs.  Nothing but labelled rows is learnt from.

Training is bounded: at most ``sample`` documents of each toxic label, none longer
than ``longest`` characters, and a vocabulary of ``words`` words and stems, chosen
by their association with the last label and kept as 64-bit hashes.

Edge cases: null, empty and word-free texts get the probabilities of no words;
very long texts are scored whole; without labelled rows of both kinds every
probability is 0; a label that is null in some rows is learnt from the others, and
one without both kinds there is 0 throughout; ids that occur in one table only or
repeatedly pair as a join pairs them; repeated rows are scored alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textops
from .sampling import bounded, fold

#: Label columns in the order of the chain.
CHAIN = ("quality", "toxic")
#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-casing of A-Z, and which lower-cased bytes belong to words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    word = np.zeros(256, bool)
    word[0x61:0x7B] = word[0x30:0x3A] = word[0x80:] = True
    return lower, word


LOWER, IS_WORD = _tables()


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their leading bytes, and the index of each row's first.

    Each word gives ``1 + len(STEMS)`` hashes; a stem as long as the word or longer is 0.
    """
    data, offsets = textops.utf8(column)
    data = LOWER[data]
    starts, ends, first = textops.word_bounds(data, offsets, IS_WORD)
    ranged = textops.RangeHash(textops.byte_symbols(3)[data])
    out = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    out[:, 0] = textops.mix(ranged.of(starts, ends))
    for k, stem in enumerate(STEMS, 1):
        longer = np.flatnonzero(ends - starts > stem)
        out[longer, k] = textops.mix(ranged.of(starts[longer], starts[longer] + stem) + np.uint64(stem))
    return out.ravel(), first * out.shape[1]


def presence(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word of the sorted vocabulary) pairs, by row."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == hashes)
    row = np.searchsorted(first, known, "right") - 1
    pairs = np.unique(row * len(vocabulary) + at[known])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _distinct(texts: list[str], block: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of all texts, by row; a few texts are held at a time."""
    rows, found = [], []
    for at in range(0, len(texts), block):
        hashes, first = word_hashes(pa.array(texts[at : at + block], pa.large_string()))
        for k in range(len(first) - 1):
            own = np.unique(hashes[first[k] : first[k + 1]])
            rows.append(np.full(len(own), at + k))
            found.append(own)
    return np.concatenate(rows), np.concatenate(found)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_link(row: np.ndarray, word: np.ndarray, n: int, size: int, extra: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.2, decay: float = 1e-4) -> np.ndarray:
    """Weights of the words, then of the ``extra`` columns, then the intercept (Adam).

    Words count by the logarithm of how much more of the one kind of rows holds
    them, so a few telling words outweigh many accidental ones.
    """
    share = [(np.bincount(word[own], minlength=size) + 0.5) / (k.sum() + 1) for k, own in ((k, k[row]) for k in (y == 1, y != 1))]
    ratio = np.log(share[0] / share[1])
    theta = np.zeros(size + extra.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for k in range(1, rounds + 1):
        z = np.bincount(row, (theta[:size] * ratio)[word], n) + extra @ theta[size:-1] + theta[-1]
        error = (_sigmoid(z) - y) * balance
        gradient = np.concatenate([np.bincount(word, error[row], size) * ratio, extra.T @ error, [error.sum()]])
        gradient[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return np.concatenate([theta[:size] * ratio, theta[size:]])


def _apply_link(theta: np.ndarray, row: np.ndarray, word: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
    size = len(theta) - 1 - extra.shape[1]
    return _sigmoid(np.bincount(row, theta[word], n) + extra @ theta[size:-1] + theta[-1])


@dataclass(frozen=True)
class Chain:
    """Sorted word hashes and the weights of the links, in the order of ``CHAIN``."""

    vocabulary: np.ndarray
    links: tuple[np.ndarray, ...]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """One column for each link."""
        hashes, first = word_hashes(column)
        n = len(first) - 1
        row, word = presence(hashes, first, self.vocabulary)
        out = np.zeros((n, 0))
        for theta in self.links:
            out = np.column_stack([out, _apply_link(theta, row, word, n, out)])
        return out if self.links else np.zeros((n, len(CHAIN)))


def train(texts: list[str], labels: np.ndarray, words: int = 2000, folds: int = 3) -> Chain:
    """Choose ``words`` words and fit the links, each on out-of-fold earlier links.

    ``labels`` has a column of 0, 1 or -1 (unknown) for each link; the last has no unknowns.
    """
    n = len(texts)
    if not n or len(set(labels[:, -1].tolist())) < 2:
        return Chain(np.zeros(0, np.uint64), ())
    row, hashes = _distinct(texts)
    all_words, word = np.unique(hashes, return_inverse=True)  # the first is 0, "no stem", which rows of both kinds hold
    last = labels[:, -1]
    seen = np.bincount(word, minlength=len(all_words))
    with_label = np.bincount(word, last[row], len(all_words))
    # squared distance from independence, as in a chi-squared test, for words seen at least three times
    expected = seen * last.mean()
    gain = np.where(seen >= 3, (with_label - expected) ** 2 / np.maximum(expected * (1 - last.mean()), 1e-9), -1)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:words])
    vocabulary = all_words[chosen]
    named = np.isin(word, chosen)
    row, word = row[named], np.searchsorted(chosen, word[named])
    part = np.arange(n) % folds
    links, earlier = [], np.zeros((n, 0))
    for y in labels.T:
        links.append(_fit_rows(row, word, len(vocabulary), earlier, y, y >= 0))
        unseen = np.zeros(n)
        for k in range(folds):
            theta = _fit_rows(row, word, len(vocabulary), earlier, y, (y >= 0) & (part != k))
            unseen[part == k] = _apply_link(theta, row, word, n, earlier)[part == k]
        earlier = np.column_stack([earlier, unseen])
    return Chain(vocabulary, tuple(links))


def _fit_rows(row: np.ndarray, word: np.ndarray, size: int, extra: np.ndarray, y: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Weights learnt from the rows ``inside``; of no effect but the intercept where these are of one kind."""
    if len(set(y[inside].tolist())) < 2:
        return np.append(np.zeros(size + extra.shape[1]), -30.0)
    own, to_part = inside[row], np.cumsum(inside) - 1
    return _fit_link(to_part[row[own]], word[own], int(inside.sum()), size, extra[inside], y[inside].astype(float))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chain: tuple[str, ...] = CHAIN,
    sample: int = 1200,
    longest: int = 200_000,
    folds: int = 5,
) -> Chain:
    """Train on at most ``sample`` documents of each value of the chain's last label outside the held-out fold."""
    known = labels.where(F.col(chain[-1]).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != 0))
    names = [f"x_y{k}" for k in range(len(chain))]
    known = known.select(F.col(id_col).cast("long").alias("x_id"), *[F.coalesce((F.col(c) == 1).cast("int"), F.lit(-1)).alias(y) for c, y in zip(chain, names, strict=True)])
    rows = [r for y in (0, 1) for r in bounded(known.where(F.col(names[-1]) == y), "x_id", sample)]
    if not rows:
        return train([], np.zeros((0, len(chain))))
    wanted = F.broadcast(documents.sparkSession.createDataFrame(rows, known.schema))  # twice ``sample`` rows at most
    texts = documents.select(F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text")).where(F.coalesce(F.length("x_text"), F.lit(0)) <= longest)
    rows = sorted(texts.join(wanted, "x_id").collect(), key=lambda r: (r.x_id, *[r[y] for y in names], r.x_text or ""))
    return train([r.x_text or "" for r in rows], np.array([[r[y] for y in names] for r in rows]).reshape(-1, len(chain)))


def score(documents: DataFrame, chain: Chain, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), piece_bytes: int = 1 << 19) -> DataFrame:
    """The columns in ``carry`` and ``p_<category> double`` for each row."""
    textops.bounded_batches(documents.sparkSession)
    source = documents.select(*carry, F.col(text_col).alias("x_text"))
    names = [f"p_{c}" for c in CHAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textops.pieces(batches, "x_text", piece_bytes):
            p = chain.probabilities(piece.column("x_text"))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *(pa.array(p[:, j]) for j in range(len(names)))], [*carry, *names])

    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], *(StructField(x, DoubleType()) for x in names)]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learnt from ``labels`` outside the held-out fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, chain).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), *[f"p_{c}" for c in CHAIN], (F.col("p_toxic") >= 0.5).alias("toxic"))
