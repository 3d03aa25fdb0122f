"""Preference formatting: one prompt for a pair of conversations and two masked completions.

The turns that a chosen and a rejected conversation have in common at their
start (same role and text) are rendered once as the prompt; each conversation's
other turns are rendered as its completion, with the character spans that the
loss covers: the assistant's words and the marker that ends them. All turns of
a pair meet in one shuffle on the pair's id.

Defined results: turns are in order of ``turn`` (null last), then role and
text; rows repeated wholly are one turn; a null role counts as ``user`` and a
null text as empty; rows of a null conversation belong to no pair and are left
out; a pair that lacks a side, has equal conversations, has a marker in a text or
a marker's character in a role (it could pass for a turn that nobody wrote), or
has no assistant turn in a completion is returned with that ``status``, of
several the first named; an empty table gives an
empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import need, table

#: A turn is rendered as OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _spans(turns: Column, trained: str) -> Column:
    """Character spans [start, end) of the trained role's text and end marker in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + len(OPEN) + F.length(t["role"]) + len(CLOSE)
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == trained, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda state: state["out"])


def preference_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for a pair: ``pair_id, status, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans``.

    ``turns`` has ``pair_id, chosen`` (boolean: the side), ``turn, role, text``.
    """
    row = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.where("pair_id IS NOT NULL").groupBy("pair_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("chosen"), row))).alias("c"), F.array_sort(F.collect_set(F.when(~F.col("chosen"), row))).alias("r"))
    said = lambda t: F.struct(t["role"], t["text"])
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: F.coalesce(said(a) != said(b), F.lit(True)) | a.isNull() | b.isNull()), True)
    common = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int")
    pairs = pairs.withColumn("n_common", common)
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    forged = lambda side: F.exists(side, lambda t: F.contains(t["text"], F.lit(OPEN)) | F.rlike(t["role"], F.lit("[<|>\\n]")))
    pairs = pairs.select("pair_id", "n_common", (forged("c") | forged("r")).alias("marker"), F.slice("c", 1, F.col("n_common")).alias("p"), rest("c").alias("cr"), rest("r").alias("rr"), F.size("c").alias("nc"), F.size("r").alias("nr"))
    trains = lambda side: F.exists(side, lambda t: t["role"] == trained)
    status = (F.when((F.col("nc") == 0) | (F.col("nr") == 0), "one_side").when((F.size("cr") == 0) & (F.size("rr") == 0), "equal").when(F.col("marker"), "marker")
              .when(~trains("cr") | ~trains("rr"), "nothing_to_train").otherwise("ok"))
    return pairs.select("pair_id", status.alias("status"), "n_common", _render(F.col("p")).alias("prompt"),
                        _render(F.col("cr")).alias("chosen"), _spans(F.col("cr"), trained).alias("chosen_spans"),
                        _render(F.col("rr")).alias("rejected"), _spans(F.col("rr"), trained).alias("rejected_spans"))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) are a pair; spans are given as ``start:end`` joined by blanks."""
    t = need(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    t = t.select(F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), " ").alias(c)
    return preference_pairs(t).select("pair_id", "status", "n_common", "prompt", "chosen", text("chosen_spans"), "rejected", text("rejected_spans"))


OP10_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i FROM t),
c AS (SELECT * FROM n WHERE side), r AS (SELECT * FROM n WHERE NOT side),
z AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i,
             c.i IS NOT NULL AND r.i IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
      FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.i = r.i),
p AS (SELECT pair_id, CAST(coalesce(min(CASE WHEN NOT coalesce(same, FALSE) THEN i END), max(i) + 1) - 1 AS INTEGER) AS n_common FROM z GROUP BY pair_id),
s AS (SELECT n.*, p.n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM n JOIN p USING (pair_id)),
e AS (SELECT *, CAST(sum(length(shown)) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS stop FROM s WHERE i > n_common),
m AS (SELECT pair_id, side, string_agg(shown, '' ORDER BY i) AS rest, count(*) AS k, bool_or(role = 'assistant') AS trains,
             string_agg((stop - length(text) - 8) || ':' || stop, ' ' ORDER BY i) FILTER (WHERE role = 'assistant') AS spans
      FROM e GROUP BY pair_id, side),
q AS (SELECT pair_id, string_agg(shown, '' ORDER BY i) AS prompt FROM s WHERE side AND i <= n_common GROUP BY pair_id),
h AS (SELECT pair_id, bool_or(side) AS has_c, bool_or(NOT side) AS has_r, bool_or(contains(text, '<|') OR regexp_matches(role, '[<|>\n]')) AS marker FROM n GROUP BY pair_id)
SELECT p.pair_id,
       CASE WHEN NOT has_c OR NOT has_r THEN 'one_side' WHEN mc.k IS NULL AND mr.k IS NULL THEN 'equal' WHEN marker THEN 'marker'
            WHEN NOT coalesce(mc.trains, FALSE) OR NOT coalesce(mr.trains, FALSE) THEN 'nothing_to_train' ELSE 'ok' END AS status,
       n_common, coalesce(prompt, '') AS prompt, coalesce(mc.rest, '') AS chosen, coalesce(mc.spans, '') AS chosen_spans,
       coalesce(mr.rest, '') AS rejected, coalesce(mr.spans, '') AS rejected_spans
FROM p JOIN h USING (pair_id) LEFT JOIN q USING (pair_id)
     LEFT JOIN m mc ON mc.pair_id = p.pair_id AND mc.side LEFT JOIN m mr ON mr.pair_id = p.pair_id AND NOT mr.side
"""
