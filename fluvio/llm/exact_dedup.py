"""Exact deduplication through counting quotient filters.

1. One scan gives every document a 64-bit fingerprint of its normalised text
   (A-Z lower-cased, nothing else).
2. Every partition builds a counting quotient filter of its fingerprints: the
   high bits (quotient) name a run, the run holds the sorted low bits
   (remainders) with their counts. Filters are cut by quotient range; the
   pieces of a range are merged by their sorted remainders, which loses
   nothing as quotient and remainder together are the whole fingerprint. A
   text copied a billion times is one entry of each partition's filter.
3. Fingerprints counted once are unique texts. Those counted more often route
   their documents to byte verification: their texts are grouped by the
   normalised bytes themselves, so a fingerprint collision cannot join
   different texts; each row then meets its group by the text's SHA-256.

Defined results: null text counts as empty; of equal texts the row with the
largest id stays (a null id loses against any other); of wholly repeated rows
(same id and text) one is kept; an empty table gives an empty result; further
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm import words as W
from fluvio.llm.common import map_arrow, need, table, write_table

#: Distinct fingerprints that one merge task is meant to hold.
RANGE_ROWS = 1 << 21


@dataclass
class QuotientFilter:
    """Counting quotient filter: run lengths by quotient, sorted remainders with counts."""

    bits: int  # quotient bits
    runs: np.ndarray  # remainders in each quotient's run
    remainders: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int | None = None) -> QuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        fp = fingerprints[order]
        n = np.ones(len(fp), dtype=np.uint64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, np.int64)
        fp, n = fp[first], np.add.reduceat(n, first) if len(fp) else n
        bits = max(1, int(len(fp)).bit_length()) if bits is None else bits
        low = np.uint64(64 - bits)
        runs = np.bincount((fp >> low).astype(np.int64), minlength=1 << bits)
        return QuotientFilter(bits, runs, fp & ((np.uint64(1) << low) - np.uint64(1)), n)

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (quotient << np.uint64(64 - self.bits)) | self.remainders

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all the filters' fingerprints; counts add up."""
        return QuotientFilter.build(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def dump(self) -> bytes:
        parts = [W.pack(self.runs), W.pack(self.remainders), W.pack(self.counts)]
        return b"".join([np.array([self.bits, *map(len, parts)], dtype="<u8").tobytes(), *parts])

    @staticmethod
    def load(data: bytes) -> QuotientFilter:
        bits, *sizes = (int(x) for x in np.frombuffer(data, dtype="<u8", count=4))
        cut = np.cumsum([32, *sizes])
        runs, remainders, counts = (W.unpack(data[a:b]) for a, b in zip(cut[:-1], cut[1:]))
        return QuotientFilter(bits, runs.astype(np.int64), remainders, counts)

    def ranges(self, n: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filter cut into at most ``n`` (a power of two) ranges of fingerprints."""
        fp = self.fingerprints()
        edge = np.searchsorted(fp, np.arange(n, dtype=np.uint64) * np.uint64(2**64 // n) if n > 1 else np.zeros(1, np.uint64))
        for r, (a, b) in enumerate(zip(edge, [*edge[1:], len(fp)])):
            if b > a:
                yield r, QuotientFilter.build(fp[a:b], self.counts[a:b])


def fingerprinted(docs: DataFrame, texts: bool) -> DataFrame:
    """``doc_id, fp, sha`` of every row, and with ``texts`` the normalised bytes as ``norm``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            norm = [x.lower() for x in batch.column("text").to_pylist()]
            cols = [batch.column("doc_id"), pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in norm], dtype=np.uint64).view(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string())]
            names = ["doc_id", "fp", "sha"]
            yield pa.record_batch([*cols, pa.array(norm, pa.binary())] if texts else cols, names=[*names, "norm"] if texts else names)

    rows = need(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, fp bigint, sha string" + ", norm binary" * texts)


def repeated_fingerprints(prints: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``fp, n``: the fingerprints that occur more than once, from merged partition filters."""
    n = 1 << max(0, (max(1, prints.count()) - 1) // range_rows).bit_length()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = QuotientFilter.build(np.zeros(0, np.uint64))
        waiting: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            parts = list(mine.ranges(n))
            return pa.record_batch([pa.array([r for r, _ in parts], pa.int32()), pa.array([f.dump() for _, f in parts], pa.binary())], names=["range", "filter"])

        for batch in batches:
            waiting.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, waiting)) >= range_rows // 4:
                mine, waiting = QuotientFilter.merge([mine, QuotientFilter.build(np.concatenate(waiting))]), []
                if len(mine.counts) >= range_rows:
                    yield send()
                    mine = QuotientFilter.build(np.zeros(0, np.uint64))
        if waiting:
            mine = QuotientFilter.merge([mine, QuotientFilter.build(np.concatenate(waiting))])
        if len(mine.counts):
            yield send()

    def merge(group: pa.Table) -> pa.Table:
        all_ = QuotientFilter.merge([QuotientFilter.load(x) for x in group.column("filter").to_pylist()])
        many = all_.counts > 1
        return pa.table({"fp": pa.array(all_.fingerprints()[many].view(np.int64)), "n": pa.array(all_.counts[many].astype(np.int64))})

    filters = map_arrow(prints.select("fp"), build, "range int, filter binary")
    return filters.groupBy("range").applyInArrow(merge, "fp bigint, n bigint")


def verified_groups(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``fp, sha, keep_id, group_size`` of the texts with a repeated fingerprint, grouped by their very bytes.

    Copies collapse within a task before any shuffle, so a hot text sends one
    row a task. After the bytes have decided, the SHA-256 names the group; two
    texts with one SHA-256 would end the job.
    """
    rows = fingerprinted(docs, texts=True).join(repeated, "fp")
    groups = rows.groupBy("fp", "norm").agg(F.first("sha").alias("sha"), F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("norm")
    groups = write_table(groups, "dedup-groups")
    if groups.groupBy("fp", "sha").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different texts have the same SHA-256")
    return groups


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for a row of ``docs``."""
    prints = write_table(fingerprinted(docs, texts=False), "dedup-prints")
    repeated = write_table(repeated_fingerprints(prints), "dedup-repeated").select("fp")
    groups = verified_groups(docs, repeated)
    # Both sides are plain tables of narrow rows, so Spark splits the rows of a hot text over tasks.
    rows = write_table(prints.join(groups, ["fp", "sha"], "left"), "dedup-rows")
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    alone = rows.where("group_size IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    grouped = rows.where("group_size IS NOT NULL")
    cols = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    others = grouped.where(~keeper).withColumn("kept", F.lit(False)).select(*cols)
    # One row with the id that stays, unless it is repeated (a text may have no id in any row): then the first of them.
    keepers = write_table(grouped.where(keeper).withColumn("rid", F.monotonically_increasing_id()), "dedup-keepers")
    first = keepers.groupBy("fp", "sha").agg(F.min("rid").alias("rid")).withColumn("kept", F.lit(True))
    keepers = keepers.join(first, ["fp", "sha", "rid"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return alone.union(others).union(keepers.select(*cols))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
