"""Exact n-gram Jaccard join: candidates from rare-first prefixes, verified in prefix trees.

1. One scan turns every text into its set of word n-grams (64-bit hashes). The
   pairs (n-gram, document) are dealt by n-gram, as compressed blocks, and each
   n-gram learns how many documents have it. One that several documents of a
   block have travels once, with their number, and its documents stay with the
   block. N-grams of one document only can never be shared; the others go back
   to their block, so every document knows its shareable n-grams in the global
   order (rare first).
2. A document whose shareable n-grams are fewer than any partner would need in
   common has no partner. Of the others, equal sets form a class, represented
   once. Partners must have one of the first ``shareable - needed + 1``
   n-grams of each in common (prefix filter), so classes that meet at such an
   n-gram are the candidates. At the first n-gram that two similar sets have in
   common, both have all their overlap from there on (positional filter): a row
   (n-gram, class) knows the largest partner that this allows, and of any pair
   the smaller class must allow one of its own size. An n-gram without such a
   class is done; so a template's n-grams, which its pages have behind more
   n-grams of their own than similar pages may, form no pair at all.
3. Candidates of a probe class are stored in prefix trees: their ordered sets
   sorted, each with the length it shares with its neighbour. A probe walks the
   tree once; overlaps counted on a shared path are kept for all sets below it,
   and a subtree goes when its overlap so far plus the length that remains
   cannot reach what is needed.
4. A group of classes at one n-gram is not paired with itself as a whole. It is
   compared with one of its classes first, the likeliest centre (of those that
   allow their own size, that with the fewest n-grams of its own), which is then
   settled there; later rounds take sixteen times as many each, and large groups
   are salted by class. A group whose classes have become one component is done:
   components, not links, are wanted. When the pairs that are left are few for
   each row that there was at first, the next round takes all, which ends it.
   Sizes, positions, n-grams of their own and a 256-bit parity sketch rule out
   most dissimilar pairs before any is formed.

Defined results: null or empty texts have no n-grams and link with nothing;
a text of fewer than ``n`` words has its whole sequence as its one n-gram;
repeated rows are documents of their own, in one component; null ids are
ignored in the least id (and null is the component where all ids are null); an
empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm import words as W
from fluvio.llm.common import chunks, input_bytes, map_arrow, need, send_package, table, write_table
from fluvio.llm.components import components
from fluvio.llm.decontaminate import document_key

#: N-grams of a block of documents.
BLOCK = 1 << 21
#: Bytes of input (as stored) for each part of the n-grams.
PART_BYTES = 8 << 20
#: Set elements of a prefix tree.
TREE = 1 << 20
#: Groups are compared with probes while more than so many pairs are left for each first row, each round with so many times the probes of the last.
FEW, MORE = 3, 16
#: Classes of a group that one task compares with a round's probes.
SALT = 2048


#: Columns of a set's sketch: the parities of its shareable n-grams in 256 hash buckets.
SKETCH = ("k0", "k1", "k2", "k3")


def parity(key: np.ndarray) -> np.ndarray:
    """Two sets' sketches differ in no more bits than the sets differ in elements."""
    bits = (np.bincount((key >> np.uint64(17)).astype(np.int64) & 255, minlength=256) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of ``n`` elements with any partner."""
    return -(-percent * n // 100)


def shingle_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``rid, doc_id, doc_key, n, s1, s2, tokens, prefix``: one row for a row of ``docs``.

    ``s1, s2`` identify the set. ``tokens`` (packed) are the shareable n-grams,
    rare first, and ``prefix`` how many of them a partner may meet; both null
    for a document without possible partners.
    """
    send_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = need(docs, doc_id="doc_id", text="text").select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", document_key(F.col("doc_id"), F.col("text")).alias("doc_key"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    parts = max(8, -(-input_bytes(docs) // PART_BYTES))
    info = pa.schema([("rid", pa.int64()), ("doc_id", pa.null()), ("doc_key", pa.string()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def send() -> pa.RecordBatch:
            batch = pa.Table.from_batches([w[0] for w in waiting]).combine_chunks().to_batches()[0]
            count = np.concatenate([np.diff(w[2]) for w in waiting])
            key = np.concatenate([w[1] for w in waiting])
            waiting.clear()
            at = np.concatenate(([0], np.cumsum(count)))
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(key * np.uint64(m)), dtype=np.uint64))) for m in (3, 5)]
            table_ = pa.table([*batch.columns, pa.array(count, pa.int32()), *[pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]],
                              names=info.names)
            block = int(batch.column(0)[0].as_py())
            doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            edges = np.array([-(-(p << 64) // parts) for p in range(parts)], dtype=np.uint64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((first, [len(key)])))
            many = times > 1
            here, docs_, again, count_ = key[first[~many]], doc[first[~many]], key[first[many]], times[many]
            cut, cut2 = np.searchsorted(here, edges), np.searchsorted(again, edges)
            out = [(p, block, W.pack_sorted(here[a:b]), W.pack(docs_[a:b]), W.pack_sorted(again[c:d]), W.pack(count_[c:d]))
                   for p, (a, b, c, d) in enumerate(zip(cut, [*cut[1:], len(here)], cut2, [*cut2[1:], len(again)])) if b > a or d > c]
            stay = np.repeat(many, times)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table_.schema) as stream:
                stream.write_table(table_)
            out.append((-1 - block, block, sink.getvalue().to_pybytes(), W.pack_sorted(key[stay]), W.pack(doc[stay]), b""))
            cols = list(zip(*out))
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["part", "block", *"abcd"])

        for batch in chunks(batches, "text", 1 << 20):
            key, at = W.shingles(batch.column("text"), n)
            waiting.append((batch.select(["rid", "doc_id", "doc_key"]), key, at))
            if sum(len(w[1]) for w in waiting) + 64 * sum(w[0].num_rows for w in waiting) >= BLOCK:
                yield send()
        if waiting:
            yield send()

    def share(group: pa.Table) -> pa.Table:
        """The n-grams of a part that several documents have, sorted back to their blocks with the number of documents."""
        names = ["block", *"abcde"]
        if group.num_rows == 0 or group.column("part")[0].as_py() < 0:
            return group.select(["block", "a", "b", "c"]).append_column("d", pa.array([b""] * group.num_rows, pa.binary())).append_column("e", pa.array([b""] * group.num_rows, pa.binary()))
        blocks = group.column("block").to_pylist()
        keys = [W.unpack_sorted(x) for x in group.column("a").to_pylist()]
        docs_ = [W.unpack(x) for x in group.column("b").to_pylist()]
        again = [W.unpack_sorted(x) for x in group.column("c").to_pylist()]
        key = np.concatenate([*keys, *again])
        times = np.concatenate([*[np.ones(len(k), np.uint64) for k in keys], *[W.unpack(x) for x in group.column("d").to_pylist()]])
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        df = np.empty(len(key), dtype=np.uint64)
        df[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.concatenate((first, [len(key)]))))
        ends = np.cumsum([len(k) for k in (*keys, *again)])
        df_of = np.split(df, ends[:-1])
        out = []
        for block, k, d, f, k2, f2 in zip(blocks, keys, docs_, df_of, again, df_of[len(keys):]):
            many = f > 1
            if many.any() or len(k2):
                out.append((block, W.pack_sorted(k[many]), W.pack(d[many]), W.pack(f[many]), W.pack_sorted(k2), W.pack(f2)))
        cols = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.binary()] * 5))], names=names)

    def assemble(group: pa.Table) -> pa.Table:
        rows_ = list(zip(*(group.column(c).to_pylist() for c in "abcde")))
        own = next(r for r in rows_ if not r[3])  # the block's own row: its documents, and the n-grams that stayed
        info_ = pa.ipc.open_stream(own[0]).read_all()
        stayed, holders = W.unpack_sorted(own[1]), W.unpack(own[2])
        parts_ = [(W.unpack_sorted(a), W.unpack(b), W.unpack(c)) for a, b, c, d, _ in rows_ if d]
        known = [(W.unpack_sorted(d), W.unpack(e)) for _, _, _, d, e in rows_ if d]
        if parts_:
            again, times = (np.concatenate(x) for x in zip(*known))
            order = np.argsort(again)
            if len(stayed):
                parts_.append((stayed, holders, times[order][np.searchsorted(again[order], stayed)]))
        key, doc, df = (np.concatenate(x) for x in zip(*parts_)) if parts_ else (np.zeros(0, np.uint64),) * 3
        order = np.lexsort((key, df, doc))
        key, doc = key[order], doc[order]
        m = info_.num_rows
        at = np.searchsorted(doc, np.arange(m + 1, dtype=np.uint64))
        size = info_.column("n").to_numpy()
        shared = np.diff(at)
        prefix = np.where((size > 0) & (shared >= needed(size, percent)), shared - needed(size, percent) + 1, 0)
        tokens = [W.pack(key[a:b]) if p else None for a, b, p in zip(at[:-1], at[1:], prefix)]
        return info_.append_column("tokens", pa.array(tokens, pa.binary())).append_column("prefix", pa.array(prefix, pa.int32(), mask=prefix == 0))

    dealt = map_arrow(rows, split, "part bigint, block bigint, a binary, b binary, c binary, d binary")
    back = dealt.groupBy("part").applyInArrow(share, "block bigint, a binary, b binary, c binary, d binary, e binary")
    return back.groupBy("block").applyInArrow(
        assemble, f"rid bigint, doc_id {kind}, doc_key string, n int, s1 bigint, s2 bigint, tokens binary, prefix int")


class PrefixTree:
    """Ordered sets as a trie: sorted sequences, each with the length of the path it shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets[:-1], self.sets[1:]):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.shared.append(int(differ[0]) if len(differ) else k)

    def overlaps(self, probe: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int]]:
        """(index of a set, overlap with ``probe``) wherever the overlap is at least ``least`` of that index."""
        probe = np.sort(probe)
        path = np.zeros(1, dtype=np.int64)  # overlap of the walked path, by depth
        for i, set_, shared in zip(self.order, self.sets, self.shared):
            depth = min(shared, len(path) - 1)
            path = path[:depth + 1]
            if path[-1] + min(len(set_) - depth, len(probe) - path[-1]) < least[i]:
                continue  # the walk ends here for all sets below that need as much
            rest = set_[depth:]
            there = probe[np.minimum(np.searchsorted(probe, rest), len(probe) - 1)] == rest if len(probe) else np.zeros(len(rest), bool)
            path = np.concatenate((path, path[-1] + np.cumsum(there)))
            if path[-1] >= least[i]:
                yield i, int(path[-1])


def verified(pairs: DataFrame, classes: DataFrame, percent: int, tree: int = TREE) -> DataFrame:
    """The pairs ``probe, other`` whose sets reach the similarity, as edges ``a, b``."""
    sets = classes.select(F.col("cid").alias("other"), F.col("n").alias("other_n"), "tokens")
    pairs = write_table(pairs.join(classes.select(F.col("cid").alias("other"), F.col("n").alias("other_n")), "other"), "jaccard-pairs")
    blocks = pairs.groupBy("probe").agg(F.ceil(F.sum("other_n") / tree).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "probe").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")).drop("other_n")
    others = dealt.join(sets, "other").select("probe", "block", "other", "other_n", "tokens")
    own_sets = classes.select(F.col("cid").alias("own"), F.col("n").alias("own_n"), F.col("tokens").alias("own_tokens"))
    probes = dealt.select(F.col("probe").alias("own"), F.col("block").alias("own_block")).distinct().join(own_sets, "own")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        own = W.unpack(right.column("own_tokens")[0].as_py())
        total = left.column("other_n").to_numpy().astype(np.int64) + right.column("own_n")[0].as_py()
        found = PrefixTree([W.unpack(x) for x in left.column("tokens").to_pylist()]).overlaps(own, -(-percent * total // (100 + percent)))
        b = left.column("other").to_numpy()[np.array([i for i, _ in found], dtype=np.int64)]
        return pa.table({"a": pa.array([right.column("own")[0].as_py()] * len(b), pa.int64()), "b": pa.array(b, pa.int64())})

    return others.groupBy("probe", "block").cogroup(probes.groupBy("own", "own_block")).applyInArrow(walk, "a bigint, b bigint")


#: Columns of a row (n-gram, class): the class, its size, the largest partner that its position allows, n-grams of its own, component and sketch.
MET = ("token", "cid", "n", "most", "private", "label", *SKETCH)


def _apart(met: DataFrame) -> DataFrame:
    """The rows that may still find a partner of another component at their n-gram, with the group's size ``k``.

    Of two similar classes that first meet there, the smaller one allows its own
    size (``most >= n``), and each allows the other's.
    """
    able = F.col("most") >= F.col("n")
    group = met.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.when(able, F.col("n"))).alias("low"), F.max(F.when(able, F.col("most"))).alias("high"))
    group = group.where("x < y AND low IS NOT NULL").select("token", "k", "low", "high")
    return write_table(met.select(*MET).join(group, "token").where("low <= most AND high >= n").select(*MET, "k"), "jaccard-met")


def _left(met: DataFrame) -> tuple[int, int]:
    """(rows, pairs of classes of different components at one n-gram, one of which allows its own size)."""
    pairs = lambda k, s: F.col(s) * (F.col(k) - F.col(s)) + F.col(s) * (F.col(s) - 1) / 2
    each = met.groupBy("token", "label").agg(F.count("*").alias("k"), F.count_if(F.col("most") >= F.col("n")).alias("s"))
    each = each.groupBy("token").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum(pairs("k", "s")).alias("same"))
    r = each.agg(F.sum("k").alias("rows"), F.sum(pairs("k", "s") - F.col("same")).alias("pairs")).first()
    return r.rows or 0, int(r.pairs or 0)


def similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``rid, doc_id, doc_key, n_shingles, component_id, group``, one row for a row of ``docs``.

    ``group`` is the component itself (a row that links with none is its own),
    whatever its ids: never null, and different components never share it.
    """
    spark = docs.sparkSession
    sets = write_table(shingle_sets(docs, n, percent), "jaccard-sets")
    identity = ["n", "s1", "s2"]
    classes = write_table(sets.where("prefix IS NOT NULL").groupBy(*identity).agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("least"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix")), "jaccard-classes")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [W.unpack(t) for t in batch.column("tokens").to_pylist()]
            keys = [k[:p] for k, p in zip(sets_, batch.column("prefix").to_pylist())]
            if keys:
                each = np.array([len(k) for k in keys])
                left = np.concatenate([len(s) - np.arange(len(k)) for s, k in zip(sets_, keys)])  # n-grams from here on
                size = batch.column("n").to_numpy()
                private = size - np.array([len(k) for k in sets_], dtype=np.int32)
                sketch = np.stack([parity(k) for k in sets_])
                most = left * (100 + percent) // percent - np.repeat(size, each)
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(most.astype(np.int32)), *[pa.array(np.repeat(c, each)) for c in (
                    batch.column("cid").to_numpy(), size, private.astype(np.int32), *sketch.T)]], names=["token", "most", "cid", "n", "private", *SKETCH])

    met = map_arrow(classes.select("cid", "n", "tokens", "prefix"), prefixes, "token bigint, most int, cid bigint, n int, private int, " + ", ".join(f"{k} bigint" for k in SKETCH))
    met = _apart(met.withColumn("label", F.col("cid")))
    edges = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))

    def may_link(other: str) -> Column:
        """Whether sizes, positions and sketches allow a class and one whose columns start with ``other`` to be similar."""
        n, m = F.col("n"), F.col(f"{other}n")
        both = n + m
        differ = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"{other}{k}"))) for k in SKETCH), F.col("private") + F.col(f"{other}private"))
        overlap = F.ceil(percent * both / (100 + percent))
        return (m <= F.col("most")) & (n <= F.col(f"{other}most")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= both - 2 * overlap)

    probes_each, at_first = 1, None
    while True:
        rows, pairs = _left(met)
        if not pairs:
            break
        at_first = at_first or rows
        last = pairs <= FEW * at_first
        # The class with the fewest n-grams of its own is the likeliest centre of a group.
        place = F.expr("row_number() OVER (PARTITION BY token ORDER BY private, cid)")
        probes = met.where("most >= n")
        probes = probes if last else probes.withColumn("place", place).where(F.col("place") <= probes_each).drop("place")
        probes = write_table(probes.select(*[F.col(c).alias(f"p_{c}") for c in met.columns], F.explode(F.expr(f"sequence(0L, (k - 1) DIV {SALT})")).alias("p_salt")), "jaccard-probes")
        salted = met.withColumn("salt", F.pmod(F.xxhash64("cid"), F.expr(f"(k - 1) DIV {SALT} + 1")))
        once = (F.col("cid") > F.col("p_cid")) | (F.col("most") < F.col("n")) if last else F.lit(True)
        pairs = salted.join(probes, (F.col("token") == F.col("p_token")) & (F.col("salt") == F.col("p_salt")) & (F.col("label") != F.col("p_label")) & once & may_link("p_"))
        edges = write_table(edges.union(verified(pairs.select(F.col("p_cid").alias("probe"), F.col("cid").alias("other")).distinct(), classes, percent)), "jaccard-edges")
        if last:
            break
        label = components(edges).select(F.col("node").alias("cid"), F.col("label").alias("now"))
        # A probe has met its whole group, so its pairs there are settled.
        settled = probes.where("p_salt = 0").select(F.col("p_token").alias("token"), F.col("p_cid").alias("cid"))
        rest = met.join(settled, ["token", "cid"], "left_anti").join(label, "cid", "left")
        met = _apart(rest.withColumn("label", F.coalesce("now", "label")).drop("now"))
        probes_each *= MORE
    label = components(edges).select(F.col("node").alias("cid"), "label")
    classes = classes.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "label").select(*identity, "component_id", "label", F.lit(True).alias("linked"))
    return sets.join(classes, identity, "left").select(
        "rid", "doc_id", "doc_key", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("label", "rid").alias("group"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for a component (that with the least id), columns unchanged."""
    found = write_table(similar(docs), "jaccard-similar")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("f"))
    stays = found.join(first, "group").withColumn("stays", F.col("rid") == F.col("f.rid"))
    keys = stays.groupBy(F.col("doc_key").alias("__key")).agg(F.count("*").alias("__rows"), F.sum(F.col("stays").cast("int")).alias("__stay")).where("__stay < __rows")
    keys = write_table(keys, "jaccard-keys")
    keyed = docs.withColumn("__key", document_key(docs["doc_id"], docs["text"]))
    others = keyed.join(keys, "__key", "left_anti").drop("__key")
    twice = keys.where("__stay > 0").select("__key")
    if twice.isEmpty():
        return others
    # Repeated rows (same id and text) are of one component, so one of them stays; they are written, so that a hot key's join can be split.
    repeated = write_table(keyed.join(twice, "__key"), "jaccard-repeated").dropDuplicates(["__key"])
    return others.union(repeated.select(*docs.columns))


def op5_jaccard_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
