"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_features`` turns every whole text into statistics in one scan;
``fit_trees`` boosts trees on binned statistics of labelled rows; the trees
are flattened into arrays, and ``score`` walks all rows of a batch through
them with numpy, one array step for a level.

The fit takes at most ``max_train_rows`` labelled rows (those whose id hashes
smallest; a documented bound, 50,000 by default), everything else covers all
rows. Defined results: a null or empty text has all-zero statistics and still
gets a score; repeated rows are scored each; of labels that contradict one
another for an id the mean decides (a tie counts as 1); with no labelled row
of both classes the score is the share of class 1 (0.5 without any label);
further columns of the inputs play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fluvio.llm import words as W
from fluvio.llm.common import chunks, map_arrow, need, table, write_table

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "white", "newline", "upper", "digit", "sentence_mark",
    "bang", "bar", "symbol", "bracket", "non_ascii", "distinct_words", "top_word", "repeated_next", "distinct_trigrams",
    "short_words", "upper_words", "title_words", "marked_words", "line_length", "words_per_mark",
)
_CLASS = np.zeros((9, 256), dtype=np.float32)
for _row, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(65, 91)), b"0123456789", b".,;:?", b"!", b"|", b"#$%&*@^~_=+\\/<>", b"()[]{}\"'")):
    _CLASS[_row, list(_chars)] = 1

_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!#$%&*|@^~")] = True


def statistics(col: pa.Array) -> np.ndarray:
    """The ``FEATURES`` of every text of a binary column, as float32 rows."""
    data, off = W.buffers(col)
    start, end, _ = W.spans(data, off)
    h, at = W.word_hashes(col)
    n, out = len(col), np.zeros((len(col), len(FEATURES)), dtype=np.float32)
    code = np.zeros(len(data), dtype=np.uint8)
    for k, row in enumerate(_CLASS):
        code[row[data] > 0] = k + 1
    code[data >= 128] = 10
    length = end - start
    first, last = data[start], data[np.maximum(end - 1, 0)]
    capital = (first >= 65) & (first <= 90)
    upper_total = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    shouted = (upper_total[end] - upper_total[start]) * 2 > length
    marked = _MARK[last]
    tri = W.mix(h[:-2] * np.uint64(3) + W.mix(h[1:-1] * np.uint64(5) + h[2:])) if len(h) > 2 else h[:0]
    for i in range(n):
        a, b, w0, w1 = off[i], off[i + 1], at[i], at[i + 1]
        size, words = b - a, w1 - w0
        if not words:
            out[i, 0] = np.log1p(size)
            continue
        share = np.bincount(code[a:b], minlength=11) / size
        _, counts = np.unique(h[w0:w1], return_counts=True)
        ln = length[w0:w1]
        marks = share[5] * size
        out[i] = (
            np.log1p(size), np.log1p(words), ln.mean(), np.log1p(ln.max()), share[1], share[2], share[3], share[4], share[5],
            share[6], share[7], share[8], share[9], share[10], len(counts) / words, counts.max() / words,
            (h[w0 + 1:w1] == h[w0:w1 - 1]).mean() if words > 1 else 0,
            len(np.unique(tri[w0:w1 - 2])) / (words - 2) if words > 2 else 1,
            (ln <= 3).mean(), shouted[w0:w1].mean(), (capital[w0:w1] & ~shouted[w0:w1]).mean(), marked[w0:w1].mean(),
            np.log1p(size / (1 + share[2] * size)), np.log1p(words / (1 + marks)),
        )
    return out


def document_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, features array<float>``, one row for a row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            flat = pa.array(statistics(batch.column("text")).reshape(-1), pa.float32())
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32())
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "features"])

    rows = need(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, features array<float>")


@dataclass
class Trees:
    """Flattened complete trees: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a value above goes right
    leaf: np.ndarray  # trees x leaves, learning rate included
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while len(x) and at[0] < len(f):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 5.0) -> Trees:
    """Second-order boosting for log loss; splits come from per-node histograms of gradients."""
    inner, n, m = 2**depth - 1, *x.shape
    p = (y.sum() + 0.5) / (n + 1)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), float(np.log(p / (1 - p))))
    if n == 0 or y.min() == y.max():
        model.base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))) if n else 0.0
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    margin, grown = np.full(n, model.base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, s = q - y, q * (1 - q)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(depth):
            nodes, low = 2**level, 2**level - 1
            key = ((at - low)[:, None] * (m * bins) + flat).reshape(-1)
            hist = [np.bincount(key, np.repeat(v, m), nodes * m * bins).reshape(nodes, m, bins) for v in (g, s)]
            left_g, left_s = (np.cumsum(v, axis=2) for v in hist)
            all_g, all_s = left_g[:, :1, -1:], left_s[:, :1, -1:]
            gain = left_g**2 / (left_s + l2) + (all_g - left_g)**2 / (all_s - left_s + l2) - all_g**2 / (all_s + l2)
            gain[(left_s < 2) | (all_s - left_s < 2)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[low + k], threshold[low + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_g, leaf_s = (np.bincount(at - inner, v, inner + 1) for v in (g, s))
        leaf = -rate * leaf_g / (leaf_s + l2)
        margin += leaf[at - inner]
        grown.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.stack(v) for v in zip(*grown))
    return model


def fit(features: DataFrame, labels: DataFrame, max_train_rows: int = 50_000, **params) -> Trees:
    """Trees for the rows of ``features`` (``doc_id, features``) that ``labels`` (``doc_id, label`` 0/1) covers."""
    y = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    rows = features.join(y, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_train_rows)
    got = rows.select("features", "label").toArrow()
    x = got.column("features").combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, np.float32)
    return fit_trees(flat.reshape(got.num_rows, len(FEATURES)).astype(np.float32), got.column("label").to_numpy().astype(float), **params)


def score(features: DataFrame, model: Trees) -> DataFrame:
    """``features`` and ``score double``, the probability of label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.record_batch([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, "score"])

    return map_arrow(features, run, StructType([*features.schema.fields, StructField("score", DoubleType())]))


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train_rows: int = 50_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; rows held out (crc32(id) mod 4 = 2) teach nothing."""
    f = write_table(document_features(docs), "quality-features")
    teach = need(labels, doc_id="doc_id", label="quality").where(~held_out("doc_id", 4, 2))
    model = fit(f, teach, max_train_rows)
    return score(f, model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    f = write_table(document_features(docs), "quality-features")
    model = fit(f, need(labels, doc_id="doc_id", label="quality").where(~held_out("doc_id", 4, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            x = statistics(batch.column("text").cast(pa.binary()))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return map_arrow(docs, run, docs.schema)


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
