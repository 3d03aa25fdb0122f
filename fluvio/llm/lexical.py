"""Ranked lexical search: a document FP-tree, searched by branch and bound.

A document's term vector, restricted to the terms of the items and ordered by
falling document frequency, is a path in a prefix tree, so documents share the
nodes of their common terms. A node stands for a run of documents in that
order and keeps, over its subtree, the maximum of each term's tf, the minimum
of m and the least document id. The sum over an item's terms of
``w * ((10^9 tf) div (1000 tf + 12 m))`` with those maxima and that minimum is no
less than any score below, as a term's part rises with tf and falls with m.
The search goes depth first with the items still alive; at each node an item
whose bound is under its 20th best score so far goes (at an equal bound only if
its 20th has a smaller id than any below). A leaf is one vector with its tf and
m, where scores are exact; documents alike in all of that are ranked by id.

One scan of the texts leaves each document's length and restricted vector in a
table; N, L and df come from that table, and each task builds trees of up to
``TREE`` documents of it, one after the other, taking its best scores along.
Items go in blocks whose terms have ``BLOCK_BYTES`` at most (a larger single
item is a block of its own); a block is what is broadcast. The tasks' at most 20
rows an item and task meet in one window. Numbers are 64-bit integers but for
the weight's logarithm.

Defined results: null and empty texts have no term and no result; items are the
distinct rows of (id, text), so an item without terms has no result and a null id is
an id; rows of equal score are in order of doc_id, nulls last, and repeated
documents are ranked each; empty tables give an empty result; further columns
play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import map_arrow, need, table, write_table

TOP = 20
TREE = 4096
BLOCK_BYTES = 16 << 20
#: A term in UTF-8 after A-Z are a-z: ASCII letters and digits, and all beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return _TERM.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only


def _vectors(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and its known terms with their tf."""
    number = known.value
    for batch in batches:
        n, ids, tfs = [], [], []
        for text in batch.column("text").to_pylist():
            found = terms(text)
            tf = {number[t]: c for t, c in Counter(found).items() if t in number}
            n.append(len(found))
            ids.append(list(tf))
            tfs.append(list(tf.values()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])


class Items:
    """The items of a block, by term: item ``who[at[t]:at[t + 1]]`` has term t with ``gain`` = weight times its repeats."""

    def __init__(self, items: list[Counter], weight: np.ndarray):
        self.count = len(items)
        rows = sorted((t, i, c) for i, item in enumerate(items) for t, c in item.items())
        term = np.array([r[0] for r in rows], dtype=np.int64)
        self.who = np.array([r[1] for r in rows], dtype=np.int64)
        self.gain = weight[term] * np.array([r[2] for r in rows], dtype=np.int64) if rows else np.zeros(0, dtype=np.int64)
        self.at = np.searchsorted(term, np.arange(len(weight) + 1))
        self.mine = np.full(self.count, -1, dtype=np.int64)

    def scores(self, term: np.ndarray, part: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """For the items ``alive``, the sum of gain * part over the given terms."""
        first, size = self.at[term], self.at[term + 1] - self.at[term]
        place = np.arange(size.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        who = self.who[place]
        self.mine[alive] = np.arange(len(alive))
        at = self.mine[who]
        self.mine[alive] = -1
        there = at >= 0
        out = np.zeros(len(alive), dtype=np.int64)
        np.add.at(out, at[there], self.gain[place[there]] * np.repeat(part, size)[there])
        return out


def parts(tf: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The ``TOP`` best (score, smaller id first) of every item."""

    def __init__(self, count: int, top: int):
        self.top = top
        self.rows: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
        self.score = np.zeros(count, dtype=np.int64)  # of the last place, once all places are taken; a result has more than 0
        self.id = np.full(count, -_LAST, dtype=np.int64)

    def add(self, item: int, score: int, docs: list[tuple[int, int]]) -> None:
        """``docs``: (id, or the greatest integer for null; 1 for null)."""
        rows = self.rows[item]
        rows.extend((-score, *d) for d in docs[:self.top])
        if len(rows) >= self.top:
            rows.sort()
            del rows[self.top:]
            self.score[item], self.id[item] = -rows[-1][0], rows[-1][1]

    def worth(self, alive: np.ndarray, bound: np.ndarray, least: int) -> np.ndarray:
        """Whether a document of a score up to ``bound`` and an id from ``least`` may enter."""
        return (bound > self.score[alive]) | ((bound == self.score[alive]) & (least < self.id[alive]))


class Tree:
    """FP-tree of documents: sorted paths, and for each node its run of leaves with tf maxima, least m and least id."""

    def __init__(self, doc: list[tuple[int, int]], m: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        alike: dict[tuple, list[tuple[int, int]]] = {}
        for d, k, (t, f) in zip(doc, m.tolist(), vectors):
            if len(t):
                alike.setdefault((tuple(t.tolist()), tuple(f.tolist()), k), []).append(d)
        self.leaves = sorted(alike)
        self.docs = [sorted(alike[x]) for x in self.leaves]
        self.path = [x[0] for x in self.leaves]
        self.flat = np.array([t for p in self.path for t in p], dtype=np.int64)
        self.tf = np.array([f for x in self.leaves for f in x[1]], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in self.path], dtype=np.int64)))
        self.m = np.array([x[2] for x in self.leaves], dtype=np.int64)
        self.least = np.array([d[0][0] for d in self.docs], dtype=np.int64)

    def node(self, lo: int, hi: int, depth: int) -> tuple:
        """(lo, hi, depth shared, terms below with tf maxima, least m, least id) of the leaves lo..hi, which share ``depth`` terms or more."""
        a, b = self.path[lo], self.path[hi - 1]
        most = min(len(a), len(b))
        while depth < most and a[depth] == b[depth]:  # the first and last of sorted paths share what all share
            depth += 1
        t, f = self.flat[self.at[lo]:self.at[hi]], self.tf[self.at[lo]:self.at[hi]]
        if hi - lo > 1:
            order = np.argsort(t, kind="stable")
            t, f = t[order], f[order]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            t, f = t[first], np.maximum.reduceat(f, first)
        return lo, hi, depth, t, f, self.m[lo:hi].min(), int(self.least[lo:hi].min())

    def children(self, lo: int, hi: int, depth: int) -> Iterator[tuple]:
        """The nodes below: a path that ends here, then runs by the next term."""
        i = lo
        while i < hi:
            if len(self.path[i]) == depth:
                j = i + 1  # alike in terms, not in tf or m: a leaf of its own
            else:
                j, t = i + 1, self.path[i][depth]
                while j < hi and self.path[j][depth] == t:
                    j += 1
            yield self.node(i, j, depth)
            i = j

    def search(self, items: Items, best: Best) -> None:
        """Depth first, each item as long as its bound is worth it."""
        if not self.leaves:
            return
        stack = [(self.node(0, len(self.leaves), 0), np.arange(items.count))]
        while stack:
            (lo, hi, depth, term, tf, m, least), alive = stack.pop()
            bound = items.scores(term, parts(tf, m), alive)
            go = (bound > 0) & best.worth(alive, bound, least)
            alive, bound = alive[go], bound[go]
            if not len(alive):
                continue
            if hi - lo == 1:
                for item, score in zip(alive.tolist(), bound.tolist()):
                    best.add(item, score, self.docs[lo])
            else:
                stack.extend((n, alive) for n in self.children(lo, hi, depth))


def _search(batches: Iterator[pa.RecordBatch], block, tree: int, top: int) -> Iterator[pa.RecordBatch]:
    """A task's best documents of every item of the block."""
    keys, items, rank, n_all, l_all = block.value
    best = Best(items.count, top)
    doc: list[tuple[int, int]] = []
    size: list[int] = []
    vectors: list[tuple[np.ndarray, np.ndarray]] = []

    def grow() -> None:
        m = 75 + (25 * np.array(size, dtype=np.int64) * n_all) // max(l_all, 1)
        Tree(doc, m, vectors).search(items, best)
        doc.clear(), size.clear(), vectors.clear()

    for batch in batches:
        d, n = batch.column("doc_id"), batch.column("n").to_pylist()
        t, f = batch.column("term"), batch.column("tf")
        off = t.offsets.to_numpy()
        flat_t, flat_f = rank[t.values.to_numpy()], f.values.to_numpy().astype(np.int64)
        for i, (d_i, n_i) in enumerate(zip(d.to_pylist(), n)):
            order = np.argsort(mine := flat_t[off[i]:off[i + 1]])
            doc.append((_LAST, 1) if d_i is None else (d_i, 0))
            size.append(n_i)
            vectors.append((mine[order], flat_f[off[i]:off[i + 1]][order]))
            if len(doc) == tree:
                grow()
    grow()
    rows = [(k, -s, None if null else d) for k, found in zip(keys, best.rows) for s, d, null in found]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["key", "score", "doc_id"])


def _blocks(items: DataFrame, most: int) -> list[list[int]]:
    """Keys of the items, dealt into blocks of at most ``most`` bytes of text each."""
    out, size = [[]], 0
    for key, n in items.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("key").toLocalIterator():
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(key)
        size += n
    return out


def search(items: DataFrame, docs: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, tree: int = TREE) -> DataFrame:
    """``item_id, text, rank, doc_id, score`` of the ``top`` best documents of every item.

    ``items`` has ``item_id, text``, ``docs`` has ``doc_id, text``.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    items = write_table(items.select("item_id", "text").distinct().withColumn("key", F.monotonically_increasing_id()), "search-items")
    found = None
    for keys in _blocks(items, block_bytes):
        mine = items.where(F.col("key").between(keys[0], keys[-1])) if keys else items.limit(0)
        block = [(k, Counter(terms(bytes(x) if x is not None else None))) for k, x in mine.select("key", F.col("text").cast("binary")).orderBy("key").collect()]
        number = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
        known = spark.sparkContext.broadcast(number)
        vectors = write_table(map_arrow(texts, partial(_vectors, known=known), "doc_id long, n long, term array<int>, tf array<int>"), "search-vectors")
        total = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        n_all, l_all = total[0], total[1] or 0
        df = np.zeros(len(number), dtype=np.int64)
        for t, c in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for a term of the block at most
            df[t] = c
        weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * c + 1))) for c in df.tolist()], dtype=np.int64)
        order = np.argsort(-df, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        names = {t: int(rank[i]) for t, i in number.items()}
        held = spark.sparkContext.broadcast(([k for k, _ in block], Items([Counter({names[t]: c for t, c in x.items()}) for _, x in block], weight[order]), rank, n_all, l_all))
        part = map_arrow(vectors, partial(_search, block=held, tree=tree, top=top), "key long, score long, doc_id long")
        found = part if found is None else found.union(part)
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id ASC NULLS LAST)")).where(F.col("rank") <= top)
    return ranked.join(items, "key").select("item_id", "text", "rank", "doc_id", "score")


def op12_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    items = need(table(spark, sf_dir, "benchmark"), item_id="item_id", text="text")
    return search(items, need(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")).select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH dt AS (SELECT doc_id, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM (SELECT *, row_number() OVER () AS id FROM documents)),
bt AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
       FROM (SELECT DISTINCT item_id, text FROM benchmark)),
total AS (SELECT count(DISTINCT id) AS n_all, count(*) AS l_all FROM dt),
n AS (SELECT id, count(*) AS n FROM dt GROUP BY id),
tf AS (SELECT id, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM dt WHERE t IN (SELECT t FROM bt) GROUP BY id, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
m AS (SELECT id, 75 + (25 * n * n_all) // l_all AS m FROM n, total),
s AS (SELECT item_id, text, id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM bt JOIN tf USING (t) JOIN w USING (t) JOIN m USING (id) GROUP BY item_id, text, id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST, id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
