"""Katz backoff language model over word bigrams, fitted and applied by Spark.

``P(w|h) = d(n) * n / Z(h)`` for a bigram counted ``n`` times in training, else
``alpha(h) * P(w)``; ``P(w) = d(n) * n / Z`` for a known word, and the words
never seen share what is left as one unknown word. ``d`` are Good-Turing
discounts for counts up to ``K`` (1 above, and wherever the counts of counts
give none between 0 and 1). ``Z(h)`` is the context's count, or one more where
discounting would leave nothing. ``alpha(h)`` is what seen bigrams leave,
divided by the sum of ``P`` over the words not seen after ``h``: so every
context's probabilities sum to 1 exactly. A text starts in the context BEGIN
and ends with the token END.

Tables (below the shared folder): ``unigrams``, a row for a word; ``bigrams``
and ``backoff``, a row for each part, holding the part's bigrams or contexts as
sorted compressed arrays. Words are 64-bit hashes.

How the work is dealt. Words that make up at least 1/``heads`` of the training
tokens (``heads`` at most, whatever the corpus) are broadcast with their
counts. A bigram with a rare word goes to that word's part; one whose context
is rare to the context's; one of two frequent words to its context's part, or
by both words when the context alone outweighs a part. So no part grows with a
hot word, and a rare word's count is known where its bigrams are. Bigrams that
make up 1/``heads`` of the training tokens (``heads`` at most, all of two
frequent words) are broadcast as well and scored in the scan's task, so no part
gets the occurrences of a hot bigram either. Of the others each document
block sends its bigrams once: they meet the part's counts, back off there if
unseen, and sums for each document return to the block. Only an unseen bigram
of two rare words asks a second part for its context's backoff weight.

Defined results: null and empty texts hold the one token END; repeated rows
are scored and counted each; an empty training set leaves every word unknown
with probability 1; an empty table gives an empty result; further columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm import words as W
from fluvio.llm.common import chunks, input_bytes, map_arrow, need, send_package, table, write_table
from fluvio.llm.quality import held_out

#: Counts up to K are discounted.
K = 5
#: Bound on the words that are broadcast (16 bytes each, and 16 more with their backoff), and on the bigrams (16 bytes each).
HEADS = 1 << 20
#: Tokens of a block of documents.
BLOCK = 1 << 20
#: Bytes of input (as stored) for each part of the bigrams.
PART_BYTES = 8 << 20

_U = np.uint64
_TOP = _U(1 << 63)  # set in the id of a rare word
_END = W.mix(np.array([1], dtype=np.uint64))[0]
FREQUENT, RARE_CONTEXT, RARE_WORD, INFO, BACKOFF = range(5)


def good_turing(times: list[float], k: int = K) -> np.ndarray:
    """Discounts ``d[0..k+1]`` from ``times[r-1]``, the number of n-grams counted r times, r up to k+1."""
    d = np.ones(k + 2)
    if times[0] > 0:
        a = (k + 1) * times[k] / times[0]
        for r in range(1, k + 1):
            if times[r - 1] > 0 and a < 1:
                x = ((r + 1) * times[r] / (r * times[r - 1]) - a) / (1 - a)
                d[r] = x if 0 < x < 1 else 1.0
    return d


@dataclass
class Katz:
    tokens: int
    types: int
    parts: int
    heads: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray  # and their counts
    d1: np.ndarray
    z1: float
    unknown: float
    d2: np.ndarray = field(default_factory=lambda: np.ones(K + 2))
    # By frequent word, BEGIN last: log10 of Z and of alpha.
    log_z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))
    # Frequent bigrams (context id and word id in one, sorted) and their counts.
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def log_hot(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a bigram is one of the frequent ones, log10 P(word | context) of those)."""
        if not len(self.hot):
            return np.zeros(len(word), bool), np.zeros(0)
        key = (context << _U(32)) | word
        i = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
        there = (context < _TOP) & (word < _TOP) & (self.hot[i] == key)
        return there, self.log_seen(self.hot_counts[i[there]]) - self.log_z[context[there].astype(np.int64)]

    def log_word(self, n: np.ndarray) -> np.ndarray:
        """log10 P(w) of words counted ``n`` times."""
        p = self.d1[np.minimum(n, K + 1)] * n / self.z1
        return np.log10(np.where(n > 0, p, self.unknown))

    def log_seen(self, n: np.ndarray) -> np.ndarray:
        return np.log10(self.d2[np.minimum(n, K + 1)] * n)

    def part(self, x: np.ndarray) -> np.ndarray:
        return ((W.mix(x) >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int64)

    def ids(self, w: np.ndarray) -> np.ndarray:
        """Index of a frequent word, or the hash of another with the top bit set."""
        if not len(self.heads):
            return w | _TOP
        i = np.minimum(np.searchsorted(self.heads, w), len(self.heads) - 1)
        return np.where(self.heads[i] == w, i.astype(np.uint64), w | _TOP)

    def bigrams(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context id, word id, text) of all tokens of texts whose words are ``w[at[i]:at[i+1]]``."""
        n = len(at) - 1
        ends = at[1:] + np.arange(n)
        word = np.ones(len(w) + n, dtype=bool)
        word[ends] = False
        seq = np.full(len(w) + n, _END)
        seq[word] = w
        ids = self.ids(seq)
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))[:n]] = _U(len(self.heads))
        return context, ids, np.repeat(np.arange(n), np.diff(at) + 1)

    def deal(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, class, a, b, order): each bigram as two integers, sorted by part, class, a and b.

        Frequent: a holds both ids. Rare context: a is the context. Rare word: a is the word.
        """
        rare_w, rare_h = word >= _TOP, context >= _TOP
        class_ = np.where(rare_w, RARE_WORD, np.where(rare_h, RARE_CONTEXT, FREQUENT))
        a = np.where(rare_w, word, np.where(rare_h, context, (context << _U(32)) | word))
        b = np.where(rare_w, context, np.where(rare_h, word, _U(0)))
        # BEGIN counts as heavy, too.
        heavy = np.concatenate((self.counts * self.parts > self.tokens, [True]))
        by = a.copy()
        light = np.flatnonzero(class_ == FREQUENT)
        light = light[~heavy[context[light].astype(np.int64)]]
        by[light] = context[light]
        part = self.part(by)
        both = np.flatnonzero(class_ == FREQUENT)
        other = np.flatnonzero(class_ != FREQUENT)
        order = np.concatenate((both[np.argsort(a[both], kind="stable")], other[np.lexsort((b[other], a[other]))]))
        group = (part * 3 + class_)[order]
        order = order[np.argsort(group.astype(np.uint16) if self.parts * 3 < 1 << 16 else group, kind="stable")]
        return part, class_, a, b, order


def _cuts(part: np.ndarray, class_: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    group = (part * 3 + class_)[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
    for x, y in zip(first, [*first[1:], len(group)]):
        yield *(int(v) for v in divmod(group[x], 3)), slice(x, y)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _texts(docs: DataFrame, **more: Column) -> DataFrame:
    return need(docs, doc_id="doc_id", text="text").select(
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *[c.alias(name) for name, c in more.items()])


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """``w, n``: the words of the training texts, END included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.record_batch([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

        for batch in chunks(batches, "text", 1 << 20):
            waiting += [W.word_hashes(batch.column("text"))[0], np.full(batch.num_rows, _END)]
            if sum(map(len, waiting)) >= 2 * BLOCK:
                yield send()
        if waiting:
            yield send()

    return map_arrow(_texts(docs.where(train)), run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


_T2 = "part bigint, class int, a binary, b binary, n binary, times array<bigint>"


def count_bigrams(docs: DataFrame, train: Column, model: Katz) -> DataFrame:
    """A row for a part and class: its bigrams ``a, b`` and counts ``n``, packed; ``times`` counts the counts up to K+1."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, waiting = known.value, []

        def send() -> pa.RecordBatch:
            part, class_, a, b, order = m.deal(*(np.concatenate(x) for x in zip(*waiting)))
            waiting.clear()
            a, b, rows = a[order], b[order], []
            for p, c, s in _cuts(part, class_, order):
                first = _runs(a[s], b[s])
                n = np.diff(np.concatenate((first, [s.stop - s.start])))
                rows.append((p, c, W.pack_sorted(a[s][first]), W.pack(b[s][first]), W.pack(n)))
            return _batch(rows, ["part", "class", "a", "b", "n"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

        for batch in chunks(batches, "text", 1 << 20):
            waiting.append(m.bigrams(*W.word_hashes(batch.column("text")))[:2])
            if sum(len(x[0]) for x in waiting) >= BLOCK:
                yield send()
        if waiting:
            yield send()

    def merge(group: pa.Table) -> pa.Table:
        a = np.concatenate([W.unpack_sorted(x) for x in group.column("a").to_pylist()])
        b, n = (np.concatenate([W.unpack(x) for x in group.column(c).to_pylist()]) for c in "bn")
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = _runs(a, b)
        n = np.add.reduceat(n[order], first)
        times = np.bincount(np.minimum(n, K + 2).astype(np.int64), minlength=K + 3)[1:K + 2]
        return pa.table({"part": group.column("part").slice(0, 1), "class": group.column("class").slice(0, 1),
                         "a": pa.array([W.pack_sorted(a[first])], pa.binary()), "b": pa.array([W.pack(b[first])], pa.binary()),
                         "n": pa.array([W.pack(n)], pa.binary()), "times": pa.array([times.tolist()], pa.list_(pa.int64()))})

    dealt = map_arrow(_texts(docs.where(train)), run, "part bigint, class int, a binary, b binary, n binary")
    return dealt.groupBy("part", "class").applyInArrow(merge, _T2)


def contexts(bigrams: DataFrame, model: Katz) -> DataFrame:
    """``h, log_z, log_alpha`` of every context (h: id as a signed long, negative for a rare word)."""
    known = bigrams.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for c, a, b, n in zip(*(batch.column(x).to_pylist() for x in ("class", "a", "b", "n"))):
                a, b, n = W.unpack_sorted(a), W.unpack(b), W.unpack(n).astype(np.int64)
                if c == FREQUENT:
                    h, count = a >> _U(32), m.counts[(a & _U(0xFFFFFFFF)).astype(np.int64)]
                elif c == RARE_CONTEXT:
                    h, count = a, m.counts[b.astype(np.int64)]
                else:  # every occurrence of a rare word is in this part
                    first = _runs(a)
                    count = np.repeat(np.add.reduceat(n, first), np.diff(np.concatenate((first, [len(a)]))))
                    order = np.argsort(b, kind="stable")
                    h, n, count = b[order], n[order], count[order]
                first = _runs(h)
                sums = [np.add.reduceat(x, first) for x in (n, m.d2[np.minimum(n, K + 1)] * n, 10.0 ** m.log_word(count))]
                yield pa.record_batch([pa.array(h[first].view(np.int64)), *map(pa.array, sums)], names=["h", "n", "kept", "p"])

    parts = map_arrow(bigrams.select("class", "a", "b", "n"), run, "h bigint, n bigint, kept double, p double")
    all_ = parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("p").alias("p"))
    z = F.when(F.col("n") - F.col("kept") > 1e-9, F.col("n")).otherwise(F.col("n") + 1).cast("double")
    return all_.select("h", F.log10(z).alias("log_z"), F.log10((1 - F.col("kept") / z) / (1 - F.col("p"))).alias("log_alpha"))


def hot_bigrams(bigrams: DataFrame, model: Katz, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams that make up at least 1/``heads`` of the training tokens, sorted, and their counts."""
    least = -(-model.tokens // heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in zip(batch.column("a").to_pylist(), batch.column("n").to_pylist()):
                n = W.unpack(n).astype(np.int64)
                many = n >= max(least, 2)
                yield pa.record_batch([pa.array(W.unpack_sorted(a)[many].view(np.int64)), pa.array(n[many])], names=["a", "n"])

    rows = map_arrow(bigrams.where(F.col("class") == FREQUENT).select("a", "n"), run, "a bigint, n bigint").toArrow()  # at most ``heads`` rows
    a = rows.column("a").to_numpy().view(np.uint64)
    order = np.argsort(a)
    return a[order], rows.column("n").to_numpy()[order]


def packed_contexts(rows: DataFrame, model: Katz) -> DataFrame:
    """The rare contexts as a row for each part: sorted ids and the two logarithms."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = known.value.part(batch.column("h").to_numpy().view(np.uint64))
            yield pa.record_batch([pa.array(part), *batch.columns], names=["part", *batch.schema.names])

    def gather(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        logs = [group.column(c).to_numpy()[order].tobytes() for c in ("log_z", "log_alpha")]
        return pa.table([group.column("part").slice(0, 1), pa.array([BACKOFF], pa.int32()), pa.array([W.pack_sorted(h[order])], pa.binary()),
                         *[pa.array([x], pa.binary()) for x in logs]], names=["part", "class", "a", "b", "n"])

    placed = map_arrow(rows, place, "part bigint, h bigint, log_z double, log_alpha double")
    return placed.groupBy("part").applyInArrow(gather, "part bigint, class int, a binary, b binary, n binary")


def fit(docs: DataFrame, train: Column, heads: int = HEADS, part_bytes: int = PART_BYTES) -> tuple[Katz, DataFrame]:
    """The model and its tables (``bigrams`` and ``backoff`` in one, by part)."""
    send_package(docs.sparkSession)
    unigrams = write_table(count_words(docs, train), "katz-unigrams")
    s = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), *[F.count_if(F.col("n") == r).alias(f"r{r}") for r in range(1, K + 2)]).first()
    d1 = good_turing([s[f"r{r}"] for r in range(1, K + 2)])
    kept = s.n - sum(r * (1 - d1[r]) * s[f"r{r}"] for r in range(1, K + 1))
    z1 = float(s.n if s.n - kept > 1e-9 else s.n + 1)
    top = unigrams.where(F.col("n") * heads >= s.n).toArrow()  # at most ``heads`` rows
    hashes = top.column("w").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Katz(s.n, s.v, max(4, -(-input_bytes(docs) // part_bytes)), hashes[order], top.column("n").to_numpy()[order], d1, z1, 1 - kept / z1)
    bigrams = write_table(count_bigrams(docs, train, model), "katz-bigrams")
    times = bigrams.agg(*[F.coalesce(F.sum(F.get("times", F.lit(r))), F.lit(0)) for r in range(K + 1)]).first()
    model.d2 = good_turing(list(times))
    rows = write_table(contexts(bigrams, model), "katz-contexts")
    top = rows.where("h >= 0").toArrow()  # at most ``heads`` and BEGIN
    model.log_z, model.log_alpha = (np.zeros(len(model.heads) + 1) for _ in range(2))
    for c, out in (("log_z", model.log_z), ("log_alpha", model.log_alpha)):
        out[top.column("h").to_numpy()] = top.column(c).to_numpy()
    model.hot, model.hot_counts = hot_bigrams(bigrams, model, heads)
    backoff = write_table(packed_contexts(rows.where("h < 0"), model), "katz-backoff")
    return model, bigrams.drop("times").union(backoff)


_ROW = "part bigint, class int, block bigint, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


class _Contexts:
    """Look-up of a part's rare contexts; one never seen has Z and alpha 1."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        self.h = W.unpack_sorted(rows[0][0]) if rows else np.zeros(0, np.uint64)
        self.log_z, self.log_alpha = (np.frombuffer(x) for x in rows[0][1:]) if rows else (np.zeros(0), np.zeros(0))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.h):
            return np.zeros(len(h)), np.zeros(len(h))
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        there = self.h[i] == h
        return np.where(there, self.log_z[i], 0.0), np.where(there, self.log_alpha[i], 0.0)


class _Counts:
    """Look-up of a part's bigrams of one class."""

    def __init__(self, a: bytes, b: bytes, n: bytes):
        a, b, self.n = W.unpack_sorted(a), W.unpack(b), W.unpack(n).astype(np.int64)
        self.a, self.b = np.unique(a), np.unique(b)
        self.key = self._key(a, b)[0]
        first = _runs(a)
        self.words = np.add.reduceat(self.n, first) if len(first) else self.n  # by ``self.a``

    def _key(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        j = np.minimum(np.searchsorted(self.b, b), len(self.b) - 1)
        return i * len(self.b) + j, (self.a[i] == a) & (self.b[j] == b)

    def bigrams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key, there = self._key(a, b)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(there & (self.key[i] == key), self.n[i], 0)

    def of(self, a: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where(self.a[i] == a, self.words[i], 0)


def _sums(block: int, doc: np.ndarray, *values: np.ndarray) -> tuple:
    """A row that takes sums for each text back to its block."""
    docs, at = np.unique(doc, return_inverse=True)
    out = [np.bincount(at, v, len(docs)) for v in values]
    return -1, INFO + 1, block, W.pack_sorted(docs), *[x.tobytes() for x in out], *[b""] * (3 - len(out))


def score(docs: DataFrame, model: Katz, tables: DataFrame, train: Column) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, base, score``, one row for a row of ``docs``; ``base`` is the sum of log10(c+1)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, waiting = known.value, []

        def send() -> pa.RecordBatch:
            info = pa.Table.from_batches([x[0] for x in waiting]).combine_chunks()
            shift = np.cumsum([0, *[x[0].num_rows for x in waiting]])
            context, word = (np.concatenate([x[i] for x in waiting]) for i in (1, 2))
            doc = np.concatenate([x[3] + s for x, s in zip(waiting, shift)])
            waiting.clear()
            frequent = word < _TOP
            logs = np.log10(m.counts + 1.0)[word[frequent].astype(np.int64)]
            rows, of = info.num_rows, doc[frequent]
            info = info.append_column("n_tokens", pa.array(np.bincount(doc, minlength=rows)))
            info = info.append_column("n_known", pa.array(np.bincount(of, minlength=rows)))
            info = info.append_column("base", pa.array(np.bincount(of, logs, rows)))
            hot, log_p = m.log_hot(context, word)
            info = info.append_column("score", pa.array(np.bincount(doc[hot], log_p, rows)))
            context, word, doc = context[~hot], word[~hot], doc[~hot]
            block = int(info.column("rid")[0].as_py())
            part, class_, a, b, order = m.deal(context, word)
            a, b, doc = a[order], b[order], doc[order].astype(np.uint64)
            out = [(p, c, block, W.pack_sorted(a[s]), W.pack(b[s]) if c else b"", W.pack(doc[s]), b"") for p, c, s in _cuts(part, class_, order)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, info.schema) as stream:
                stream.write_table(info)
            out.append((-1 - block, INFO, block, sink.getvalue().to_pybytes(), b"", b"", b""))
            return _batch(out, _NAMES, _TYPES)

        for batch in chunks(batches, "text", 1 << 20):
            waiting.append((batch.select(["rid", "doc_id", "train"]), *m.bigrams(*W.word_hashes(batch.column("text")))))
            if sum(len(x[1]) for x in waiting) >= BLOCK:
                yield send()
        if waiting:
            yield send()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        m = known.value
        have = {c: (a, b, n) for c, a, b, n in zip(*(right.column(x).to_pylist() for x in ("class", "a", "b", "n")))}
        context = _Contexts([have[BACKOFF]] if BACKOFF in have else [])
        counts = {c: _Counts(*have[c]) for c in (FREQUENT, RARE_CONTEXT, RARE_WORD) if c in have}
        out = []
        for c, block, a, b, doc in zip(*(left.column(x).to_pylist() for x in ("class", "block", "a", "b", "c"))):
            if c == INFO:
                out.append((-1, INFO, block, a, b"", b"", b""))
                continue
            a, doc = W.unpack_sorted(a), W.unpack(doc)
            b = W.unpack(b) if b else np.zeros(len(a), np.uint64)
            n = counts[c].bigrams(a, b) if c in counts else np.zeros(len(a), np.int64)
            seen = n > 0
            value = np.zeros(len(a))
            value[seen] = m.log_seen(n[seen])
            if c == FREQUENT:
                h, w = (a >> _U(32)).astype(np.int64), (a & _U(0xFFFFFFFF)).astype(np.int64)
                value += np.where(seen, -m.log_z[h], m.log_alpha[h] + m.log_word(m.counts[w]))
                out.append(_sums(block, doc, value))
            elif c == RARE_CONTEXT:  # its Z is charged where the context stands as a word
                log_z, log_alpha = context(a)
                value += np.where(seen, 0.0, log_z + log_alpha + m.log_word(m.counts[b.astype(np.int64)]))
                out.append(_sums(block, doc, value))
            else:
                times = counts[c].of(a) if c in counts else n
                value += np.where(seen, 0.0, m.log_word(times)) - context(a)[0]
                frequent = b < _TOP
                h = b[frequent].astype(np.int64)
                value[frequent] += np.where(seen[frequent], -m.log_z[h], m.log_alpha[h])
                out.append(_sums(block, doc, value, np.log10(times + 1.0), (times > 0).astype(float)))
                ask = ~seen & ~frequent
                h, d = b[ask], doc[ask]
                part = m.part(h)
                order = np.lexsort((h, part))
                for p, s in ((p, s) for p, _, s in _cuts(part, np.zeros(len(part), np.int64), order)):
                    out.append((p, BACKOFF, block, W.pack_sorted(h[order][s]), b"", W.pack(d[order][s]), b""))
        return pa.Table.from_batches([_batch(out, _NAMES, _TYPES)])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        context = _Contexts(list(zip(*(right.column(x).to_pylist() for x in "abn")))[:1])
        out = [_sums(block, W.unpack(doc), np.sum(context(W.unpack_sorted(h)), axis=0))
               for block, h, doc in zip(*(left.column(x).to_pylist() for x in ("block", "a", "c")))]
        return pa.Table.from_batches([_batch(out, _NAMES, _TYPES)])

    def gather(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(x).to_pylist() for x in ("class", "a", "b", "c", "d"))))
        info = pa.ipc.open_stream(next(a for c, a, *_ in rows if c == INFO)).read_all()
        total = np.zeros((3, info.num_rows))
        for c, doc, *values in rows:
            if c != INFO:
                doc = W.unpack_sorted(doc).astype(np.int64)
                for k, v in enumerate(values):
                    if v:
                        total[k, doc] += np.frombuffer(v)
        return pa.table([info.column("doc_id"), info.column("train"), info.column("n_tokens"),
                         pa.array(info.column("n_known").to_numpy() + np.rint(total[2]).astype(np.int64)),
                         pa.array(info.column("base").to_numpy() + total[1]), pa.array(info.column("score").to_numpy() + total[0])],
                        names=["doc_id", "train", "n_tokens", "n_known", "base", "score"])

    texts = _texts(docs, rid=F.monotonically_increasing_id(), doc_id=F.col("doc_id"), train=train)
    dealt = map_arrow(texts, run, _ROW)
    first = write_table(dealt.groupBy("part").cogroup(tables.groupBy("part")).applyInArrow(look_up, _ROW), "katz-sums")
    asked = first.where("part >= 0").withColumnRenamed("part", "asked")
    second = asked.groupBy("asked").cogroup(tables.where(F.col("class") == BACKOFF).groupBy("part")).applyInArrow(answer, _ROW)
    return first.where("part < 0").union(second).groupBy("block").applyInArrow(
        gather, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base double, score double")


def op1_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = ~held_out("doc_id", 7, 2)
    model, tables = fit(docs, train)
    per_token = float(np.log10(model.tokens + model.types + 1))
    return score(docs, model, tables, train).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score")
