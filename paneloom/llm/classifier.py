"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are taken in Spark tasks. Trees are fitted on a bounded, documented sample of the
labelled rows (``most`` of them, those whose doc_id hashes lowest) and flattened into arrays: a tree is a complete
binary tree whose inner node i has a feature, a threshold and the children 2i + 1 and 2i + 2, so that numpy walks all
rows of a batch down one level at a time.

Defined results: a null text is an empty text; it has zero statistics and gets a score like any other. Labels of null
quality or null doc_id are not used, of several labels for a document the lowest counts. With no labels of both kinds
the score is the share of label 1 (0.5 without any). Repeated rows each keep a row; an empty table gives no rows.
doc_id, lang, source and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .tokenize import release

FEATURES = ("log_words", "word_length", "word_length_spread", "distinct_words", "repeated_neighbours", "symbols", "upper", "digits", "punctuation", "exclamations", "bars", "other_bytes", "lines_per_word", "dup_lines", "longest_word", "distinct_pairs", "short_words")


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER, _DIGITS = _among(bytes(range(65, 91))), _among(bytes(range(48, 58)))
_SYMBOLS, _PUNCTUATION = _among(b"#*$%&|<>"), _among(b".,;:?'\"()-")
_KINDS = np.stack([_SYMBOLS, _UPPER, _DIGITS, _PUNCTUATION, _among(b"!"), _among(b"|"), np.r_[np.zeros(128), np.ones(128)]], axis=1)


def statistics(text: str | None) -> np.ndarray:
    """The FEATURES of one whole text."""
    raw = (text or "").encode()
    out = np.zeros(len(FEATURES))
    words = raw.split()
    n = len(words)
    if not n:
        return out
    sizes = np.fromiter(map(len, words), np.int64, n)
    total = int(sizes.sum())
    kinds = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS) / total
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    out[:5] = np.log(n), total / n, sizes.std(), len(set(words)) / n, sum(map(eq, words, words[1:])) / n
    out[5:12] = kinds
    out[12:] = len(lines) / n, 1 - len(set(lines)) / len(lines), sizes.max(), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), (sizes <= 2).mean()
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of ``docs``."""

    def of(batches: Iterator[pa.RecordBatch]):
        release()
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, stats array<double>")


class Trees:
    """Boosted trees as arrays: feature and threshold are (trees, 2**depth - 1), leaf is (trees, 2**depth)."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of x."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, shrink: float = 1.0) -> Trees:
    """Log-loss boosting on histograms of gradient and curvature; a split sends values above its bin's edge right."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not n or y.min() == y.max():
        return Trees(base if n else 0.0, *(np.zeros((0, k)) for k in (inner, inner, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, at = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            gain, chosen = np.full(nodes, 1e-6), [(0, -1)] * nodes
            for j in range(width):
                cell = (at - first) * bins + binned[:, j]
                sums = [np.cumsum(np.bincount(cell, weights=w, minlength=nodes * bins).reshape(nodes, bins), axis=1) for w in (g, h, None)]
                (gl, hl, cl), (ga, ha, ca) = sums, [s[:, -1:] for s in sums]
                worth = gl**2 / (hl + shrink) + (ga - gl) ** 2 / (ha - hl + shrink) - ga**2 / (ha + shrink)
                worth[(cl < least) | (ca - cl < least)] = 0
                worth[:, len(edges[j]) :] = 0
                k = worth.argmax(axis=1)
                for i in np.flatnonzero(worth[np.arange(nodes), k] > gain):
                    gain[i], chosen[i] = worth[i, k[i]], (j, k[i])
            for i, (j, k) in enumerate(chosen):
                feature[t, first + i] = j
                threshold[t, first + i] = edges[j][k] if k >= 0 else np.inf  # without a split all rows go left
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        ends = at - inner
        gs, hs = (np.bincount(ends, weights=w, minlength=inner + 1) for w in (g, h))
        leaf[t] = -rate * gs / (hs + shrink)
        raw += leaf[t][ends]
    return Trees(base, feature, threshold, leaf)


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 5) = 0"


def trained(docs: DataFrame, labels: DataFrame, most: int = 40_000) -> Trees:
    """Trees fitted on at most ``most`` labelled documents outside the held-out fold. Labels are picked first, so that
    statistics are taken of these documents alone; only they reach the driver."""
    seen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(f"NOT ({HELD_OUT})")
    seen = seen.groupBy("doc_id").agg(F.min("quality").alias("quality")).select(F.xxhash64("doc_id").alias("order"), "doc_id", "quality").orderBy("order", "doc_id").limit(most)
    seen = F.broadcast(staged(seen, "picked"))  # ``most`` rows
    rows = with_statistics(docs.join(seen.select("doc_id"), "doc_id", "left_semi")).join(seen, "doc_id")
    got = rows.orderBy("order", "doc_id", "stats").limit(most).select("stats", "quality").toPandas()
    x = np.stack(got["stats"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["quality"].to_numpy(np.float64))


def scored(stats: DataFrame, model: Trees, cut: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of rows with statistics."""

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            score = model.score(np.stack(batch.column("stats").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(of, "doc_id long, score double, predicted int")


def keep_by_classifier(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with the columns of ``docs``. Texts stay where they are."""
    model = trained(docs, labels)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(model.score(np.stack([statistics(x) for x in text])) if len(text) else np.zeros(0))

    return docs.where(score("text") >= cut)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; rows of the held-out fold have taught nothing."""
    docs = table(spark, sf_dir, "documents")
    found = scored(with_statistics(docs), trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted")
