"""Toxicity: noisy-channel deobfuscation by Viterbi search, then a score of the restored text.

1. A character trigram model is counted over the plain words of all documents.
2. Disguised tokens - digits or signs for letters, letters repeated three or
   more times, letters kept apart by signs or white space, of any length -
   become a lattice: every
   character may be itself, a letter it stands for, a shorter run, or nothing (a
   separator), each at a channel cost. Viterbi search under the character
   model picks the restored word. Equal tokens are decoded once in a task.
3. Evidence is learned from labelled rows: words and word beginnings (3 to 5
   letters) whose share of toxic texts is far above that of others; a feature's
   weight is its log odds less two standard errors, so rare coincidences do not
   count. Equal texts count once.
4. A document's score is a logistic function of its restored words' evidence.

Every feature is counted and weighed. A table of features with evidence beyond
``broadcast_features`` rows (or ``BROADCAST_BYTES``) is not sent to all tasks:
blocks of texts name the features they hold and learn their weights in a join.

Fixed bound, as a parameter: ``max_train_rows`` rows for the logistic function's
few numbers. Everything else covers all rows and whole texts.

Defined results: null and empty texts are scored as texts without evidence;
repeated rows are scored each; of labels that contradict one another for an id
the mean decides (a tie counts as 1), and equal texts of different ids count once,
as 1 if any of them does; web addresses and tokens of 8 or more hexadecimal
digits are read as they are; without labels of both classes the score
is the share of class 1 (0.5 without any label); an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import chunks, map_arrow, need, table, write_table
from fluvio.llm.quality import held_out

#: Letters that a sign may stand for (fixed values of the channel).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
SEPARATORS = ".-_*~'·"
#: log probabilities of the channel.
AS_LETTER, SHORTER_RUN, SEPARATOR = math.log(0.4), math.log(0.3), math.log(0.5)

#: Letters of the character model: a-z and the letters of Latin-1; 0 is a word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_CLASS = np.zeros(0x250, dtype=np.int64)
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper()) if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250 else ord(_c)] = _i + 1
_N = len(LETTERS) + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}

_SIGNS = "".join(STANDS_FOR)
_WORD = regex.compile(r"\p{L}+")
#: A sign or separator between letters, a leading sign, a sign after a letter, or a letter three times in a row.
_DISGUISED = regex.compile(
    r"\p{L}[%s]+(?=\p{L})|^[%s]+\p{L}|\p{L}[0-9@$!|+]|(\p{L})\1\1" % (regex.escape(_SIGNS + SEPARATORS, special_only=False), regex.escape(_SIGNS, special_only=False)))
#: Identifiers are no disguised words: web addresses and long hexadecimal strings, as whole tokens.
_IDENTIFIER = regex.compile(r"^(?:https?|ftp)://|^[0-9a-f]{8,}$")
#: Signs that end a word where the blank after them is missing.
_STOPS = regex.compile(r"[.,;:?]+")
#: White space as ``str.split`` takes it.
_BLANK = r"\s\x1c-\x1f"
#: Single characters kept apart by white space.
_SPACED = regex.compile(r"(?<![^%s])(?:[\p{L}%s][%s]+){3,}[\p{L}%s](?![^%s])" % (_BLANK, *(regex.escape(_SIGNS, special_only=False), _BLANK) * 2))
#: Longer tokens are read each time and not kept.
KEPT = 64


def letter_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: letter trigrams (as ``(a * N + b) * N + c``) over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, dtype=np.int64)
        for batch in chunks(batches, "text", 1 << 20):
            text = b" ".join(batch.column("text").to_pylist()).decode("utf-8", "replace")
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            c = np.concatenate(([0, 0], _CLASS[np.minimum(code, len(_CLASS) - 1)], [0]))
            c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]  # one edge between words
            before = np.concatenate(([0], c[:-2]))
            before[c[:-1] == 0] = 0  # a word's first letter follows edges only
            gram = (before * _N + c[:-1]) * _N + c[1:]
            total += np.bincount(gram, minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return map_arrow(_rows(docs).select("text"), run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    return need(docs, doc_id="doc_id", text="text", **{c: c for c in more}).select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *more)


@dataclass
class Channel:
    """The character model and the decoder."""

    logs: np.ndarray  # log P(c | a, b), N x N x N
    memo: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def learned(counts: DataFrame) -> Channel:
        got = counts.toArrow()  # at most N**3 rows
        n = np.zeros(_N**3)
        n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
        n = n.reshape(_N, _N, _N)
        one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + _N)
        two = (n.sum(axis=0) + 20 * one) / (n.sum(axis=(0, 2))[:, None] + 20)
        return Channel(np.log((n + 20 * two[None]) / (n.sum(axis=2)[:, :, None] + 20)).astype(np.float32))

    def restore(self, token: str) -> str:
        """The likeliest word (lower case) behind a disguised token."""
        known = self.memo.get(token)
        if known is None:
            known = self._viterbi(token)
            if len(token) <= KEPT:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[token] = known
        return known

    def _viterbi(self, token: str) -> str:
        # state: the last two letters; value: (log probability, back link)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in lattice(token):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letters, cost in options:
                for (a, b), (p, back) in states.items():
                    q, x, y, link = p + cost, a, b, back
                    for c in letters:
                        k = _INDEX[c]
                        q += float(self.logs[x, y, k])
                        x, y, link = y, k, (c, link)
                    if (x, y) not in after or q > after[x, y][0]:
                        after[x, y] = (q, link)
            states = after
        (_, link) = max(((p + float(self.logs[a, b, 0]), link) for (a, b), (p, link) in states.items()), key=lambda s: s[0])
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return "".join(reversed(out))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters of the token, its readings (letters, log probability)."""
    out = []
    for run in regex.finditer(r"(.)\1*", token.lower(), regex.S):
        c, n = run[1], len(run[0])
        if c in _INDEX:
            out.append([(c * n, 0.0)] if n < 3 else [(c, SHORTER_RUN), (c * 2, SHORTER_RUN)])
        elif c in STANDS_FOR:
            out.append([(x * k, AS_LETTER) for x in STANDS_FOR[c] for k in sorted({min(n, 2), 1})])
        else:
            out.append([("", SEPARATOR)])
    return out


def read_token(token: str, channel: Channel) -> tuple[list[str], set[str]]:
    """(plain words in a lower-case token, the restored words behind it: of the whole, and of its parts between stops)."""
    plain = _WORD.findall(token)
    core = token.strip(".,;:?\"'#%&*()[]{}-_~")
    if len(core) > 2 and core[-1] in "$!|+" and core[-2] in "$!|+":
        core = core.rstrip("$!|+")  # decoration; a single sign may stand for the last letter
    if not _DISGUISED.search(core) or _IDENTIFIER.search(core):
        return plain, set()
    parts = _STOPS.split(core)
    return plain, {channel.restore(p) for p in (core, *(parts if len(parts) > 1 else ())) if len(p) > 2 and _DISGUISED.search(p)} - {""}


def read_spaced(text: str, tokens: list[str], channel: Channel) -> set[str]:
    """The words of a lower-case text (of these tokens) whose letters are kept apart by white space.

    Of a run with gaps of several widths, the whole and the words between its wider gaps.
    """
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    if not any(b - a == 3 for a, b in zip(single, single[3:])):
        return set()
    out = set()
    for m in _SPACED.finditer(text):
        out.add(channel.restore("".join(m[0].split())))
        gaps = regex.findall(r"[%s]+" % _BLANK, m[0])
        if (narrow := min(map(len, gaps))) < max(map(len, gaps)):
            words_ = regex.split(r"[%s]{%d,}" % (_BLANK, narrow + 1), m[0])
            out |= {channel.restore(w) for w in ("".join(x.split()) for x in words_) if len(w) > 3}
    return out - {""}


def words(text: str, channel: Channel) -> tuple[set[str], set[str], int]:
    """(distinct words of the text, distinct restored words, number of tokens)."""
    tokens = text.lower().split()
    read = [read_token(t, channel) for t in set(tokens)]
    return {w for plain, _ in read for w in plain}, {w for _, restored in read for w in restored} | read_spaced(text.lower(), tokens, channel), len(tokens)


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a trailing ``-``)."""
    return [word, *[word[:k] + "-" for k in (3, 4, 5) if len(word) > k]]


@dataclass
class Toxicity:
    channel: Channel
    weights: dict[str, float]
    beta: np.ndarray  # of 1, strongest evidence, log of 1 + words with evidence, their share in percent
    lengths: list[int]  # of the whole words (over 3 letters) with evidence
    table: DataFrame | None = None  # f, w: the weights, where they are too many for a broadcast

    def __post_init__(self):
        self.memo: dict[str, tuple] = {}

    def inside(self, w: str) -> set[str]:
        """The parts of a word spelt apart that may be words with evidence."""
        return {w[i:i + n] for n in self.lengths for i in range(len(w) - n + 1)} if len(w) > 6 else set()

    def wanted(self, text: str, seen: dict[str, list[str]]) -> set[str]:
        """All features whose weights ``evidence`` may ask for; ``seen`` holds those of tokens."""
        text = text.lower()
        tokens = text.split()
        out = set()
        for t in set(tokens):
            if t not in seen:
                plain, restored = read_token(t, self.channel)
                seen[t] = [f for w in {*plain, *restored} for f in features(w)]
            out.update(seen[t])
        for w in read_spaced(text, tokens, self.channel):
            out.update(features(w), self.inside(w))
        return out

    def _of(self, w: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(w)), default=0.0)

    def evidence(self, text: str) -> tuple[float, float, float]:
        """(strongest evidence, log of 1 + words with evidence, their share in percent). Equal tokens are read once in a task."""
        text, memo = text.lower(), self.memo
        tokens = text.split()
        found: dict[str, float] = {}
        for t in set(tokens):
            e = memo.get(t)
            if e is None:
                plain, restored = read_token(t, self.channel)
                e = tuple((w, x) for w in {*plain, *restored} if (x := self._of(w)))
                if len(t) <= KEPT:
                    if len(memo) > 1_000_000:
                        memo.clear()
                    memo[t] = e
            if e:
                found.update(e)
        for w in read_spaced(text, tokens, self.channel):
            x = self._of(w)
            if not x:  # several words spelt apart read as one
                x = max((self.weights.get(m, 0.0) for m in self.inside(w)), default=0.0)
            if x:
                found[w] = x
        return max(found.values(), default=0.0), math.log1p(len(found)), 100.0 * len(found) / max(len(tokens), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Newton's method for penalised logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
        beta[0] = math.log(share / (1 - share))
        return beta
    penalty = l2 * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


#: A label table up to so many rows (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_LABELS = 1 << 21
#: Features with evidence up to so many, with so many bytes, are sent to all tasks.
BROADCAST_FEATURES, BROADCAST_BYTES = 1 << 18, 8 << 20
#: Bytes of text of a block that asks for its features' weights at once.
BLOCK_BYTES = 8 << 20


def fit(docs: DataFrame, labels: DataFrame, min_docs: int = 3, least: float = 1.5, broadcast_features: int = BROADCAST_FEATURES, max_train_rows: int = 50_000) -> Toxicity:
    """The model from ``docs`` (all texts for the character model) and ``labels`` (``doc_id, label``)."""
    spark = docs.sparkSession
    channel = Channel.learned(letter_counts(docs))
    y = write_table(labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "toxic-labels")
    small = y.count() <= BROADCAST_LABELS
    labelled = lambda y: _rows(docs).join(F.broadcast(y) if small else y, "doc_id")
    known = spark.sparkContext.broadcast(channel)

    # Equal texts count once: one labelled row stands for them.
    texts = labelled(y).groupBy(F.xxhash64("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    y = write_table(texts.select("doc_id", "label"), "toxic-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def send() -> pa.RecordBatch:
            f = list(seen[0].keys() | seen[1].keys())
            return pa.record_batch([pa.array(f, pa.string()), *[pa.array([seen[k][x] for x in f], pa.int64()) for k in (1, 0)]], names=["f", "a", "b"])

        for batch in chunks(batches, "text", 1 << 20):
            for raw, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                text, found = raw.decode("utf-8", "replace").lower(), set()
                tokens = text.split()
                for t in set(tokens):
                    have = memo.get(t)
                    if have is None:
                        plain, restored = read_token(t, known.value)
                        have = list({x for w in {*plain, *restored} for x in features(w)})
                        if len(t) <= KEPT:
                            if len(memo) > 300_000:
                                memo.clear()
                            memo[t] = have
                    found.update(have)
                found.update(x for w in read_spaced(text, tokens, known.value) for x in features(w))
                seen[label].update(found)
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield send()
                seen[0].clear()
                seen[1].clear()
        yield send()

    seen = map_arrow(labelled(y).select("text", "label"), count, "f string, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = {r.label: r.n for r in y.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    weight = F.log(a / (pos + 1)) - F.log(b / (neg + 1)) - 2 * F.sqrt(1 / a + 1 / b)
    kept = write_table(seen.where(F.col("a") >= min_docs).select("f", weight.alias("w")).where(F.col("w") >= least), "toxic-features")
    whole = F.when(~F.endswith("f", F.lit("-")) & (F.length("f") > 3), F.length("f"))
    of = kept.agg(F.count("*").alias("n"), F.sum(F.octet_length("f")).alias("bytes"), F.collect_set(whole).alias("lengths")).first()
    if of.n <= broadcast_features and (of.bytes or 0) <= BROADCAST_BYTES:
        got = kept.toArrow()
        model = Toxicity(channel, dict(zip(got.column("f").to_pylist(), got.column("w").to_pylist())), np.zeros(4), sorted(of.lengths))
    else:
        model = Toxicity(channel, {}, np.zeros(4), sorted(of.lengths), kept)
    few = labelled(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows))
    learned = _evidence(few, model, "label").toArrow()
    x = np.column_stack([learned.column(c).to_numpy() for c in ("strongest", "words", "share")]) if learned.num_rows else np.zeros((0, 3))
    model.beta = _logistic(x, learned.column("label").to_numpy().astype(float))
    return model


def _evidence(rows: DataFrame, model: Toxicity, *keep: str) -> DataFrame:
    """``keep`` columns with the evidence ``strongest, words, share`` and ``score`` of each text."""
    known = rows.sparkSession.sparkContext.broadcast(replace(model, table=None))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", strongest double, words double, share double, score double"

    def judged(m: Toxicity, batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([m.evidence(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
        return pa.record_batch([*[batch.column(c) for c in keep], *[pa.array(np.ascontiguousarray(c)) for c in x.T], pa.array(m.score(x))],
                               names=[*keep, "strongest", "words", "share", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            yield judged(known.value, batch)

    if model.table is None:
        return map_arrow(rows.select(*keep, "text"), run, schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of texts, each with the distinct features it asks for."""
        for batch in chunks(batches, "text", BLOCK_BYTES):
            seen: dict[str, list[str]] = {}
            wanted = set().union(*(known.value.wanted(t.decode("utf-8", "replace"), seen) for t in batch.column("text").to_pylist()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([list(wanted)], pa.list_(pa.string()))], names=["body", "wanted"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, found in zip(batch.column("body").to_pylist(), batch.column("found").to_pylist()):
                m = replace(known.value, weights={x["f"]: x["w"] for x in found or ()})
                for part in pa.ipc.open_stream(body):
                    yield judged(m, part)

    blocks = map_arrow(rows.select(*keep, "text"), split, "body binary, wanted array<string>")
    blocks = write_table(blocks.withColumn("block", F.monotonically_increasing_id()), "toxic-blocks")
    # A feature is asked for once by a block, so a common word costs a row a block, not one a text.
    found = blocks.select("block", F.explode("wanted").alias("f")).join(model.table, "f").groupBy("block").agg(F.collect_list(F.struct("f", "w")).alias("found"))
    return map_arrow(blocks.select("block", "body").join(found, "block", "left").select("body", "found"), settle, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; rows held out (crc32(id) mod 5 = 0) teach nothing."""
    model = fit(docs, need(labels, doc_id="doc_id", label="toxic").where(~held_out("doc_id", 5, 0)))
    return _evidence(_rows(docs), model, "doc_id").select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
