"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from character, word and repetition features
of itself and its neighbours.  Forward-backward marginals of ``good``, weighted
by line length, make the document's mean, which a logistic link fitted on the
same training documents turns into the probability of label 1.

Training takes a bounded sample of labelled documents (``sample``) whose lines
carry the document's label, and runs in NumPy on the driver; scoring runs batch
by batch over whole texts and sees nothing but the text.

Edge cases: a null or empty text is one empty line and gets that line's score;
line ends are single line feeds; very long lines are one line; without labelled
rows of both kinds every score is 0.5; repeated rows are scored alike; an empty
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

LINE_END = 0x0A
#: Character classes of the features, by byte value.
LOWER, UPPER, DIGIT, SPACE, STOP, MARK, SYMBOL, WIDE, CLASSES = range(9)


def _class_table() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    for values, kind in ((range(0x61, 0x7B), LOWER), (range(0x41, 0x5B), UPPER), (range(0x30, 0x3A), DIGIT), (range(0x80, 0x100), WIDE), (b" \t\r\n\v\f", SPACE), (b".,;:'\"()-", STOP), (b"!?", MARK)):
        table[list(values)] = kind
    return table


CLASS_OF = _class_table()
IS_WORD = CLASS_OF != SPACE
#: Own features of a line: see ``line_features``.
OWN = 20


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their byte lengths, and each row's first line.

    A row has one line more than line feeds.  Own features are followed by those
    of the line before and the line after (zero beyond the row's ends).
    """
    breaks = np.flatnonzero(data == LINE_END)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    lines = int(first[-1])
    starts = np.empty(lines, np.int64)
    ends = np.empty(lines, np.int64)
    starts[first[:-1]] = offsets[:-1]
    ends[first[1:] - 1] = offsets[1:]
    at = np.arange(len(breaks)) + row_of_break
    ends[at] = breaks
    starts[at + 1] = breaks + 1
    length = ends - starts
    line_of = np.repeat(np.arange(lines), np.diff(np.append(starts, len(data))))
    counts = np.bincount(line_of * CLASSES + CLASS_OF[data], minlength=lines * CLASSES).reshape(lines, CLASSES).astype(np.float32)
    word_start, word_end, _ = textops.word_bounds(data, offsets, IS_WORD)
    hashes = textops.RangeHash(textops.byte_symbols(1)[data]).of(word_start, word_end)
    word_line = np.searchsorted(starts, word_start, "right") - 1
    words = np.bincount(word_line, minlength=lines).astype(np.float32)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    again = np.bincount(word_line[same], minlength=lines).astype(np.float32)
    last = data[word_end - 1]
    noisy = np.bincount(word_line[CLASS_OF[last] == SYMBOL], minlength=lines).astype(np.float32)
    loud = np.bincount(word_line[CLASS_OF[last] == MARK], minlength=lines).astype(np.float32)
    whole = textops.RangeHash(textops.byte_symbols(2)[data]).of(starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((whole, row))
    copied = np.zeros(lines, np.float32)
    copied[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (row[order[1:]] == row[order[:-1]]) & (length[order[1:]] > 0)
    size, n_words = np.maximum(length, 1).astype(np.float32), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    own = np.empty((lines, OWN), np.float32)
    own[:, 0] = np.log1p(length) / 8
    own[:, 1] = counts[:, UPPER] / letters
    own[:, 2] = counts[:, DIGIT] / size
    own[:, 3] = counts[:, SYMBOL] / size
    own[:, 4] = counts[:, STOP] / size
    own[:, 5] = counts[:, MARK] / size
    own[:, 6] = counts[:, SPACE] / size
    own[:, 7] = counts[:, WIDE] / size
    own[:, 8] = again / n_words
    own[:, 9] = noisy / n_words
    own[:, 10] = loud / n_words
    own[:, 11] = copied
    own[:, 12] = (counts[:, UPPER] > 0.5 * letters) & (length > 20)
    own[:, 13] = counts[:, SYMBOL] > 0.02 * size
    own[:, 14] = again > 0.05 * n_words
    own[:, 15] = noisy > 0.1 * n_words
    own[:, 16] = loud > 0.1 * n_words
    own[:, 17] = words < 3
    own[:, 18] = np.minimum(size / n_words / 16, 4)
    own[:, 19] = length == 0
    around = np.zeros((lines, 3 * OWN + 1), np.float32)
    around[:, 0] = 1
    around[:, 1 : OWN + 1] = own
    inside = row[1:] == row[:-1]
    around[1:, OWN + 1 : 2 * OWN + 1] = own[:-1] * inside[:, None]
    around[:-1, 2 * OWN + 1 :] = own[1:] * inside[:, None]
    return around, length, first


@dataclass(frozen=True)
class Model:
    """Weights of the field (difference good minus bad), transitions and the document link."""

    weights: np.ndarray
    transitions: np.ndarray
    link: tuple[float, float]


def marginals(emission: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, expected transitions, and rows' log partition.

    All rows advance together, longest first, so the steps are as many as the
    longest row has lines.
    """
    counts = np.diff(first)
    rows = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][rows], counts[rows]
    scores = np.zeros((len(emission), 2))
    scores[:, 1] = emission
    alpha, beta = scores.copy(), np.zeros_like(scores)
    steps = int(counts[0]) if len(counts) else 0
    active = [int(np.searchsorted(-counts, -t, "left")) for t in range(steps + 1)]  # rows with more than t lines
    for t in range(1, steps):
        at = begin[: active[t]] + t
        before = alpha[at - 1]
        alpha[at] += np.logaddexp(before[:, :1] + transitions[0], before[:, 1:] + transitions[1])
    for t in range(steps - 1, 0, -1):
        at = begin[: active[t]] + t
        after = beta[at] + scores[at]
        beta[at - 1] = np.logaddexp(transitions[:, 0] + after[:, :1], transitions[:, 1] + after[:, 1:])
    final = alpha[begin + counts - 1]
    partition = np.logaddexp(final[:, 0], final[:, 1])
    log_z = np.empty(len(counts))
    log_z[rows] = partition
    of_line = np.repeat(log_z, np.diff(first))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - of_line, 0))
    inner = np.ones(len(emission), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pairs[a, b] = np.exp(alpha[at - 1, a] + transitions[a, b] + scores[at, b] + beta[at, b] - of_line[at]).sum()
    return good, pairs, log_z


def document_means(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each row (an empty line weighs 1)."""
    weight = np.maximum(length, 1)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def _features_of(texts: list[str], piece_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of all texts; the driver holds the hashes of one piece at a time."""
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["x_text"])
    x, length, first = zip(*[line_features(*textops.utf8(piece.column(0))) for piece in textops.pieces(iter([whole]), "x_text", piece_bytes)], strict=True)
    return np.concatenate(x), np.concatenate(length), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for f in first]))])


def train(texts: list[str], labels: np.ndarray, rounds: int = 100, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Maximum-likelihood weights by Adam, then the document link by Newton steps."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(3 * OWN + 1), np.zeros((2, 2)), (0.0, 0.0))
    x, length, first = _features_of(texts)
    y = np.repeat(labels, np.diff(first)).astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    # rows count alike: a long document's lines share its weight
    weight = np.repeat(1 / np.diff(first), np.diff(first))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        gradient = np.append(x.T @ ((good - y) * weight) / weight.sum(), ((pairs - seen) / max(len(at), 1)).ravel()) + decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    transitions = theta[-4:].reshape(2, 2)
    good, _, _ = marginals(x @ theta[:-4], transitions, first)
    z = _logit(document_means(good, length, first))
    link = np.array([0.0, 1.0])
    design = np.stack([np.ones_like(z), z], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ link, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        link = link - np.linalg.solve(hessian, design.T @ (p - labels) + 1e-3 * link)
    return Model(theta[:-4], transitions, (float(link[0]), float(link[1])))


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text."""
    data, offsets = textops.utf8(column)
    x, length, first = line_features(data, offsets)
    good, _, _ = marginals(x @ model.weights, model.transitions, first)
    z = model.link[0] + model.link[1] * _logit(document_means(good, length, first))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2000, longest: int = 200_000, folds: int = 5) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fold, none longer than ``longest`` characters.

    Documents with several labels count with each; null labels are ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != 0))
    chosen = bounded(known.select(F.col(id_col).alias("x_id"), F.col(label_col).alias("x_label")), "x_id", sample)
    if not chosen:
        return train([], np.zeros(0))
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r.x_id, int(r.x_label)) for r in chosen], "x_id long, x_label int"))  # ``sample`` rows at most
    rows = documents.select(F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text")).where(F.coalesce(F.length("x_text"), F.lit(0)) <= longest).join(wanted, "x_id")
    rows = sorted(rows.collect(), key=lambda r: (r.x_id, r.x_label, r.x_text or ""))
    return train([r.x_text or "" for r in rows], np.array([r.x_label for r in rows]))


def score(documents: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), piece_bytes: int = 1 << 19) -> DataFrame:
    """The columns in ``carry`` and ``score double`` for each row."""
    textops.bounded_batches(documents.sparkSession)
    source = documents.select(*[F.col(c).alias(c) for c in carry], F.col(text_col).alias("x_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textops.pieces(batches, "x_text", piece_bytes):
            scores = pa.array(score_texts(model, piece.column("x_text")))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], scores], [*carry, "score"])

    fields = [f for f in source.schema.fields if f.name != "x_text"]
    return source.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def keep_good(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, piece_bytes: int = 1 << 19) -> DataFrame:
    """The rows of ``documents`` whose score is at least ``threshold``, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in textops.pieces(batches, text_col, piece_bytes):
            yield piece.filter(pa.array(score_texts(model, piece.column(text_col)) >= threshold))

    textops.bounded_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learnt from ``labels`` outside the held-out fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(documents, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
