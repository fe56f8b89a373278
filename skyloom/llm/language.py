"""Language identification by a small convolutional network over bytes.

Every text is cut into fixed-length windows of bytes (the last one padded with
zeros).  Filters of several widths run over each window, their maxima pass a
rectifier and a softmax layer, and the windows' probabilities, weighted by their
bytes, give the document's.  Training is NumPy back-propagation on the driver
over a bounded sample; scoring folds byte pairs into lookup tables.

Edge cases: a null text or one without a letter is ``und`` with score 1; a text
shorter than a window is one padded window; texts of any length are read whole;
without learnable rows every language is ``und`` with score 0; equal
probabilities go to the language that sorts first; repeated rows are scored
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textops
from .sampling import bounded_each, fold

WIDTHS = (2, 3, 4)
WINDOW = 256


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as rows of bytes, their lengths, and the text each belongs to (an empty text has one)."""
    lengths = np.diff(offsets)
    counts = np.maximum(-(-lengths // width), 1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[:-1][owner] + textops.ranges(counts) * width
    size = np.clip(offsets[1:][owner] - start, 0, width)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    grid = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    return np.where(np.arange(width) < size[:, None], grid, 0).astype(np.uint8), size, owner


@dataclass
class Network:
    """Filters ``conv[w][offset, byte, filter]``, their biases, and the softmax layer."""

    languages: tuple[str, ...]
    conv: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width the lookups that add up to it: pairs of bytes, then a single one."""
        out = []
        for w in self.conv:
            parts = [np.ascontiguousarray((w[o][:, None, :] + w[o + 1][None, :, :]).reshape(1 << 16, -1)) for o in range(0, len(w) - 1, 2)]
            out.append([*parts, np.ascontiguousarray(w[-1])] if len(w) % 2 else parts)
        return out

    def probabilities(self, grid: np.ndarray, tables: list[list[np.ndarray]], block: int = 256) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(grid), len(self.languages)), np.float32)
        for at in range(0, len(grid), block):
            rows = grid[at : at + block]
            wide = rows.astype(np.int32)
            pair = (wide[:, :-1] << 8) + wide[:, 1:]
            pooled = []
            for w, parts in zip(self.conv, tables, strict=True):
                n = rows.shape[1] - len(w) + 1
                total = parts[0].take(pair[:, :n], axis=0)
                for k, table in enumerate(parts[1:], 1):
                    total += table.take(pair[:, 2 * k : 2 * k + n] if len(table) > 256 else wide[:, 2 * k : 2 * k + n], axis=0)
                pooled.append(total.max(axis=1))
            out[at : at + block] = self._softmax(np.concatenate(pooled, axis=1))
        return out


def train(texts: list[str], langs: list[str], filters: int = 8, per_text: int = 6, steps: int = 1500, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """Back-propagation with Adam; gradients reach a filter only where its maximum lies."""
    languages = tuple(sorted(set(langs)))
    rng = np.random.default_rng(seed)
    net = Network(languages, [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS], np.zeros(filters * len(WIDTHS), np.float32), rng.normal(0, 0.3, (filters * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return net
    data, offsets = textops.utf8(pa.array(texts, pa.large_string()))
    grid, size, owner = windows(data, offsets)
    rank = rng.random(len(owner))
    order = np.lexsort((rank, owner))
    first = np.searchsorted(owner, owner[order])
    kept = order[(np.arange(len(order)) - first < per_text)]
    kept = kept[size[kept] > 0]
    # a third of the windows are shortened, so that short texts are learnt too
    grid, target = grid[kept], np.searchsorted(languages, np.array(langs)[owner[kept]])
    short = rng.random(len(kept)) < 0.33
    cut = np.where(short, rng.integers(8, WINDOW, len(kept)), WINDOW)
    grid = np.where(np.arange(WINDOW) < cut[:, None], grid, 0).astype(np.uint8)
    by_lang = [np.flatnonzero(target == k) for k in range(len(languages))]
    params = [*net.conv, net.bias, net.dense, net.dense_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        # the languages take turns, so a rare one is learnt as well as a common one
        pick = np.array([rng.choice(by_lang[k % len(by_lang)]) for k in range(batch)])
        rows, y = grid[pick], target[pick]
        pooled, where = [], []
        for w in net.conv:
            n = WINDOW - len(w) + 1
            total = w[0].take(rows[:, :n], axis=0)
            for o in range(1, len(w)):
                total += w[o].take(rows[:, o : o + n], axis=0)
            at = total.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
        before = np.concatenate(pooled, axis=1) + net.bias
        hidden = np.maximum(before, 0)
        z = hidden @ net.dense + net.dense_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        back = (p @ net.dense.T) * (before > 0)
        gradients = []
        for k, w in enumerate(net.conv):
            g = np.zeros_like(w)
            own = back[:, k * filters : (k + 1) * filters]
            for o in range(len(w)):
                np.add.at(g[o], (np.take_along_axis(rows, where[k] + o, axis=1), np.arange(filters)[None, :]), own)
            gradients.append(g + 1e-5 * w)
        gradients += [back.sum(axis=0), hidden.T @ p + 1e-4 * net.dense, p.sum(axis=0)]
        for q, g, (m, v) in zip(params, gradients, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, tables: list[list[np.ndarray]], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of each text's language and its probability."""
    data, offsets = textops.utf8(column)
    grid, size, owner = windows(data, offsets)
    p = net.probabilities(grid, tables) * np.maximum(size, 1)[:, None]
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    total = np.add.reduceat(p, first, axis=0)
    total /= total.sum(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    return best, total[np.arange(len(best)), best].astype(np.float64)


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 400, longest: int = 200_000, folds: int = 4, held_out: int = 2) -> Network:
    """Train on at most ``sample`` documents of each language outside the held-out fold.

    The languages are the distinct non-null values there (a few, not growing with
    rows).  Texts of more than ``longest`` characters, null texts and null ids are
    not learnt from; of a text at most ``per_text`` windows are (see :func:`train`).
    """
    known = documents.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= longest) & (fold(F.col(id_col), folds) != held_out))
    known = known.select(F.col(id_col).cast("long").alias("x_id"), F.col(text_col).alias("x_text"), F.col(lang_col).alias("x_lang"))
    ids = bounded_each(known.select("x_id", "x_lang"), "x_id", "x_lang", sample)
    if not ids:
        return train([], [])
    wanted = F.broadcast(documents.sparkSession.createDataFrame(ids, "x_id long, x_lang string"))  # ``sample`` rows a language at most
    rows = known.join(wanted.distinct(), ["x_id", "x_lang"]).select("x_id", "x_text", "x_lang").collect()
    rows = sorted(rows, key=lambda r: (r.x_id, r.x_lang, r.x_text))
    return train([r.x_text for r in rows], [r.x_lang for r in rows])


def identify(documents: DataFrame, net: Network, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), piece_bytes: int = 1 << 19) -> DataFrame:
    """The columns in ``carry``, ``lang_pred string`` and ``score double`` for each row."""
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    textops.bounded_batches(documents.sparkSession)
    source = documents.select(*carry, has_letter.alias("x_letter"), F.col(text_col).alias("x_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables()
        names = np.array([*net.languages, "und"], object)
        for piece in textops.pieces(batches, "x_text", piece_bytes):
            letter = piece.column("x_letter").to_numpy(zero_copy_only=False).astype(bool)
            if net.languages:
                best, p = predict(net, tables, piece.column("x_text"))
                best, p = np.where(letter, best, len(net.languages)), np.where(letter, p, 1.0)
            else:
                best, p = np.zeros(len(letter), int), np.where(letter, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-2], pa.array(names[best], pa.string()), pa.array(p)], [*carry, "lang_pred", "score"])

    return source.mapInArrow(run, StructType([*source.schema.fields[:-2], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents``, learnt outside the held-out fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, fit(documents)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
