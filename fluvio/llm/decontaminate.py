"""Benchmark decontamination by spaced seeds; DataFrame operations only.

Words are runs of letters and digits, lower-cased. A mask keeps some positions
of a short window and ignores the others, so a seed survives substituted words
at ignored positions. Seeds of all benchmark windows (a table whose size is
checked; a large benchmark is taken in blocks of items) meet the seeds of every
window of every document in a broadcast join. Documents are taken in pieces, and a
hit takes along only the words that face the item, so what waits in memory grows
neither with a document's length nor with its square. A hit that merely goes on from the
hit one word before (same mask and offset) is left out, so a passage costs a
few comparisons whatever its length. Around each other hit the benchmark text is laid over the document at the hit's offset and compared word by word. An
item shorter than the longest mask has masks of its own, over all its words, that
find it wherever as many words differ as the rule allows. A
document overlaps an item when, in some ``window`` aligned words (all of a
shorter item), at most ``substitutions`` differ.

Defined results: null or empty texts and items have no windows and match
nothing; repeated rows of documents or items (same id and text, null ids
included) give one row of the result, but items of one id with different texts
are different items; empty tables give an empty result; further columns play no
part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import need, table

#: Masks (1: kept). Five words kept in windows of 7 to 9.
MASKS = ("1101011", "11100101", "110010011")
#: Aligned words that are compared, and how many of them may differ.
WINDOW, SUBSTITUTIONS = 13, 2
#: Seeds broadcast at once (about 32 bytes each).
BLOCK_SEEDS = 1 << 20
#: Words of a document that are looked up at once (as many as the longest item has, if that is more): their hits wait in memory together.
PIECE_WORDS = 512
SEPARATOR = r"[^\p{L}\p{N}]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def may_differ(words: int, window: int, substitutions: int) -> int:
    """How many of the ``words`` aligned words (``window`` at most) may differ."""
    return min(substitutions, words * substitutions // window)


def whole_masks(words: int, differ: int) -> list[str]:
    """Masks over all ``words`` of an item, one of which is kept whole whichever ``differ`` of them are substituted.

    The positions are dealt into ``differ + 2`` groups, of which a mask ignores ``differ``.
    """
    return list(dict.fromkeys("".join("0" if k % (differ + 2) in left_out else "1" for k in range(words)) for left_out in combinations(range(differ + 2), differ)))


def seeds(words: DataFrame, masks: tuple[str, ...], whole: tuple[str, ...] = (), items: bool = False) -> DataFrame:
    """``words`` (with ``words`` and their hashes ``hs``) with ``pos``, ``mask`` and ``seed``: a row for every window and mask.

    Masks of ``whole`` are for short items: of ``items``, they are laid only over those of just their length.
    """
    at = words.select("*", F.posexplode("hs").alias("pos", "h0"))

    def seed(m: int, mask: str) -> Column:
        kept = [F.get("hs", F.col("pos") + k) if k else F.col("h0") for k, c in enumerate(mask) if c == "1"]
        fits = F.get("hs", F.col("pos") + len(mask) - 1).isNotNull()
        if items and m >= len(masks):
            fits &= F.size("hs") == len(mask)
        return F.when(fits, F.xxhash64(F.lit(m), *kept))

    return at.select(*words.columns, "pos", F.posexplode(F.array(*[seed(m, mask) for m, mask in enumerate((*masks, *whole))])).alias("mask", "seed")).where("seed IS NOT NULL")


def pieces(docs: DataFrame, span: int, margin: int) -> DataFrame:
    """Rows with ``words`` and ``hs`` as pieces of ``span`` words, with up to ``margin`` more on each side.

    ``words`` and ``hs`` of a piece begin at word ``begin`` of the document; the
    windows from ``core`` to ``core + span - 1`` are the piece's own.
    """
    def piece(at: Column) -> Column:
        begin = F.greatest(at - margin, F.lit(0))
        n = at - begin + (span + margin)
        return F.struct(begin.alias("begin"), (at - begin).alias("core"), F.slice("words", begin + 1, n).alias("words"), F.slice("hs", begin + 1, n).alias("hs"))

    rest = [c for c in docs.columns if c not in ("words", "hs")]
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(span))
    return docs.select(*rest, F.explode(F.transform(starts, piece)).alias("piece")).select(*rest, "piece.*")


def goes_on(masks: tuple[str, ...]) -> Column:
    """Whether a hit (``words, pos, item, item_pos, mask``) was a hit one word before as well; masks over whole items have no word before."""
    same = F.lit(False)
    for m, mask in enumerate(masks):
        kept = [F.get("words", F.col("pos") + (k - 1)) == F.get("item", F.col("item_pos") + (k - 1)) for k, c in enumerate(mask) if c == "1"]
        all_same = kept[0]
        for x in kept[1:]:
            all_same = all_same & x
        same = F.when(F.col("mask") == m, all_same).otherwise(same)
    return (F.col("pos") > 0) & (F.col("item_pos") > 0) & F.coalesce(same, F.lit(False))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW,
             substitutions: int = SUBSTITUTIONS, block_seeds: int = BLOCK_SEEDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``doc_id, item_id, doc_key, matched, compared, doc_start``: a row for a document and an item that overlap.

    ``matched`` of ``compared`` aligned words are equal; ``doc_start`` is the
    document's first aligned word. ``doc_key`` is ``document_key`` of the row.
    """
    hashed = lambda df: df.withColumn("hs", F.transform("words", lambda w: F.xxhash64(w)))
    tests = need(items, item_id="item_id", text="text").distinct().withColumn("item", word_array(F.col("text"))).select(
        document_key(F.col("item_id"), F.col("text")).alias("item_key"), "item_id", "item")
    longest = max(map(len, masks))
    size = F.size("item")
    got = tests.agg(F.sum(size).alias("words"), F.max(size).alias("most"), F.collect_set(F.when((size > 0) & (size < longest), size)).alias("short")).first()
    # The longest mask's length bounds the distinct lengths of short items.
    whole = tuple(m for n in sorted(got.short) for m in whole_masks(n, may_differ(min(n, window), window, substitutions)))
    blocks = -(-(got.words or 0) * (len(masks) + len(whole)) // block_seeds)
    rows = need(docs, doc_id="doc_id", text="text").select("doc_id", document_key(F.col("doc_id"), F.col("text")).alias("doc_key"), word_array(F.col("text")).alias("words"))
    margin = max(longest, got.most or 0)  # what an item that a window hits can face lies so near
    span = max(piece_words, margin)
    windows = seeds(pieces(hashed(rows), span, margin), masks, whole).where((F.col("pos") >= F.col("core")) & (F.col("pos") < F.col("core") + span))
    offset = F.col("pos") - F.col("item_pos")
    first = F.greatest(F.lit(0), -offset)  # the item's first word that faces one of the document
    n = F.least(F.col("item_words"), F.size("words") - offset) - first
    found = None
    for b in range(max(1, blocks)):
        block = tests.where(F.pmod(F.xxhash64("item_key"), F.lit(max(1, blocks))) == b)
        known = seeds(hashed(block.select("item_key", F.col("item").alias("words"))), masks, whole, items=True).select(
            "seed", "item_key", F.col("pos").alias("item_pos"), F.size("words").alias("item_words"))
        # Spark holds all hits of a piece at a time, so only the words that face the item go on from here.
        facing = windows.join(F.broadcast(known), "seed").select(
            "doc_id", "doc_key", "item_key", "item_pos", "mask", (F.col("begin") + offset + first).alias("doc_start"),
            F.slice("words", offset + first + 1, n).alias("words"), (F.col("item_pos") - first).alias("pos"))
        hits = facing.join(F.broadcast(block), "item_key").where(~goes_on(masks))
        one = _verified(hits, window, substitutions)
        found = one if found is None else found.union(one)
    best = F.max(F.struct("matched", (-F.col("compared")).alias("less"), (-F.col("doc_start")).alias("at"))).alias("best")
    return found.groupBy("doc_id", "doc_key", "item_key", "item_id").agg(best).select(
        "doc_id", "item_id", "doc_key", "best.matched", (-F.col("best.less")).alias("compared"), (-F.col("best.at")).alias("doc_start"))


def _verified(hits: DataFrame, window: int, substitutions: int) -> DataFrame:
    """Hits (``item`` and the ``words`` that face it, ``pos`` of these at ``item_pos`` of it) whose words agree well enough around some window."""
    facing = F.slice("item", F.col("item_pos") - F.col("pos") + 1, F.size("words"))
    same = F.zip_with(facing, "words", lambda a, b: (a == b).cast("int"))
    w = F.least(F.lit(window), F.size("item"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)

    def judged(s: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(s) - w), lambda i: total(F.slice(s, i + 1, w)))
        return F.struct(total(s).alias("matched"), F.size(s).alias("compared"), F.when(F.size(s) >= w, F.array_max(windows)).alias("most"))

    # The lambda over a one-element array evaluates the comparison once for a hit.
    hits = hits.withColumn("is", F.transform(F.array(same), judged)[0]).withColumn("w", w)
    return hits.where(F.col("is.most") >= F.col("w") - F.least(F.lit(substitutions), F.floor(F.col("w") * substitutions / window))).select(
        "doc_id", "doc_key", "item_key", "item_id", "doc_start", "is.matched", "is.compared")


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits of hash of id and text: equal rows are equal documents, nulls included."""
    return F.concat(*[F.hex(F.xxhash64(F.lit(k), doc_id, F.isnull(doc_id), text)) for k in (1, 2)])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, columns unchanged."""
    bad = overlaps(docs, items).select(F.col("doc_key").alias("__bad")).distinct()
    return docs.join(bad, document_key(docs["doc_id"], docs["text"]) == bad["__bad"], "left_anti")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")
