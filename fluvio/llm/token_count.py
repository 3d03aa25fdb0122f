"""Token counts: pieces are counted once for a distinct pre-token and joined to the documents' pre-token frequencies.

1. A scan counts pre-tokens (combined within a task), Spark merges them to the
   distinct ones, and each distinct pre-token is encoded once: the table
   ``pieces``.
2. A second scan turns each document into pre-token frequencies. Pre-tokens
   that make up at least 1/``heads`` of all occurrences (so ``heads`` of them
   at most, whatever the input) are joined within the task from a broadcast
   table; the others are joined to ``pieces`` by a shuffle on a 96-bit key. No
   such key has more than 1/``heads`` of the occurrences, so none is hot.
3. Frequency times pieces is summed for each document. Token ids are never kept.

The tokenizer must be a byte-level BPE with its own pre-token pattern, as in
the file given. Special strings in a text count as the library takes them: one
token each.

Defined results: a null or empty text has 0 tokens; repeated rows are counted
each; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import chunks, map_arrow, need, table, write_table

#: The byte-level pre-token pattern (a fixed value of the tokenizer's kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound on the pre-tokens that are broadcast.
HEADS = 1 << 20


def pre_tokenizer(spec: dict) -> Callable[[bytes], tuple[list[str], int]]:
    """A function from a text to (pre-tokens, number of special strings) for a tokenizer file's content."""
    import regex

    pre = spec["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] is not None:
        raise ValueError("a byte-level tokenizer without normaliser and prefix space is needed")
    find = regex.compile(PATTERN).findall
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, special))).split if special else None

    def split(text: bytes) -> tuple[list[str], int]:
        s = text.decode("utf-8", "replace")
        if cut is None or not any(x in s for x in special):
            return find(s), 0
        parts = cut(s)
        return [p for part in parts for p in find(part)], len(parts) - 1

    return split


def _rows(docs: DataFrame) -> DataFrame:
    return need(docs, doc_id="doc_id", text="text").select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def pre_token_counts(docs: DataFrame, spec: dict, flush: int = 1 << 19) -> DataFrame:
    """``piece string, n``: every distinct pre-token and its occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = pre_tokenizer(spec), Counter()

        def send() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

        for batch in chunks(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                seen.update(split(text)[0])
            if len(seen) >= flush:
                yield send()
                seen.clear()
        if seen:
            yield send()

    return map_arrow(_rows(docs).select("text"), run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def _keys(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of a hash of each piece: a long and an int."""
    import xxhash

    wide = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.encode()) for p in pieces), dtype=">u8").reshape(-1, 2)
    return wide[:, 0].astype(np.uint64).view(np.int64), (wide[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def piece_table(counts: DataFrame, content: str) -> DataFrame:
    """``counts`` with the tokens of each pre-token (``tokens``) and its join key (``h``, ``g``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            tokens = pa.array([len(e) for e in encode(pieces, add_special_tokens=False)], pa.int32())
            h, g = _keys(pieces)
            yield pa.record_batch([*batch.columns, tokens, pa.array(h), pa.array(g)], names=["piece", "n", "tokens", "h", "g"])

    return map_arrow(counts, run, "piece string, n bigint, tokens int, h bigint, g int")


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024, heads: int = HEADS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row for a row of ``docs``."""
    spark = docs.sparkSession
    content = Path(tokenizer_file).read_text()
    spec = json.loads(content) | {"model": None}
    pieces = write_table(piece_table(pre_token_counts(docs, spec), content), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    top = pieces.where(F.col("n") * heads >= total).select("piece", "tokens").toArrow()  # at most ``heads`` rows
    head = spark.sparkContext.broadcast(dict(zip(top.column("piece").to_pylist(), top.column("tokens").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = pre_tokenizer(spec), head.value
        for batch in chunks(batches, "text", 1 << 21):
            rid, size = batch.column("rid").to_numpy(), []
            known_sum, rare, row, times = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found, special = split(text)
                tokens = special
                for piece, n in Counter(found).items():
                    t = known.get(piece)
                    if t is None:
                        rare.append(piece)
                        row.append(i)
                        times.append(n)
                    else:
                        tokens += t * n
                known_sum.append(tokens)
                size.append(len(text))
            h, g = _keys(rare) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            m, k = batch.num_rows, len(rare)
            at = np.concatenate((np.arange(m), np.array(row, dtype=np.int64)))
            none = lambda a, t: pa.concat_arrays([a.cast(t), pa.nulls(k, t)])
            yield pa.record_batch([
                pa.array(np.concatenate((rid, h))), pa.array(np.concatenate((np.full(m, -1, np.int32), g))), pa.array(rid[at]),
                pa.array(np.concatenate((np.zeros(m, np.int64), np.array(times, dtype=np.int64)))),
                none(batch.column("doc_id"), batch.column("doc_id").type), none(pa.array(size), pa.int64()), none(pa.array(known_sum), pa.int64()),
            ], names=["h", "g", "rid", "times", "doc_id", "n_bytes", "known"])

    # A document's own row has a key that meets no piece; so one pass over the texts gives both kinds of rows.
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = map_arrow(_rows(docs), run, f"h bigint, g int, rid bigint, times bigint, doc_id {kind}, n_bytes bigint, known bigint")
    rare = pieces.where(F.col("n") * heads < total).select("h", "g", "tokens")
    sums = parts.join(rare, (parts.h == rare.h) & (parts.g == rare.g) & (parts.times > 0), "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("known", F.col("times") * F.col("tokens"))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
