"""URL filter: rules first, else the ratio of two character language models.

URLs that a rule decides are the examples: a smoothed Markov model of variable
order is learned from the accepted and one from the rejected ones. A model's
contexts are the up to ``ORDER`` characters before a character, as far as the
string of context and character makes up 1/``SHARE`` of all training characters
(so an order has ``SHARE`` strings at most, whatever the input: the bound of
what is broadcast); probabilities are interpolated by Witten and Bell,

    p(x | c) = (n(cx) + t(c) p(x | shorter c)) / (n(c) + t(c)),

t(c) being the number of different characters after c, and the shortest context
interpolates with a uniform distribution. A context that one class lacks passes
to its shorter one. A URL's score is the log-likelihood difference, accepted
minus rejected, for each character and the end, over their number. The threshold
is calibrated on the fifth of the ruled URLs whose MD5 says so, from which
nothing is learned: the score bin edge of the best sum of both classes' rates
(equal: nearest to 0, then the greater). Without examples of a class it is 0.

Native: windows of characters are exploded in the scan's task, looked up level
by level in broadcast tables and summed before one small shuffle. Counting
sums equal windows first. URLs are read whole; of ``pages`` only id and URL.

Defined results: a null URL has empty host and path and is scored as empty text
(the end alone); a URL without ``://`` is scored as it is; scored is all after
the first ``://`` with the host in lower case; repeated rows are judged one by
one; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.llm.common import need, table, write_table

ORDER, SHARE = 4, 1 << 16
START, END = "\x02", "\x03"
#: Score bins for the calibration: a thousandth wide, scores beyond +-16 in the outermost.
BIN, MOST = 1000, 16

#: (rule, verdict): a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: str = "url") -> tuple[Column, Column, Column]:
    """Host (lower case), path, and the text that is scored."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    raw = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.substr(rest, F.length(raw) + 1)
    path = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return host, path, F.when(at > 0, F.concat(host, after)).otherwise(u)


def rule_of(rules: tuple[tuple[str, str], ...], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. Rules of one length: the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, _, p = text.partition("/")
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def windows(text: str, order: int = ORDER) -> Column:
    """For every character and the end, it and the ``order`` characters before it."""
    chars = F.split(F.concat(F.lit(START * order), F.col(text), F.lit(END)), "")
    return F.transform(F.sequence(F.lit(1), F.size(chars) - order), lambda i: F.array_join(F.slice(chars, i, order + 1), ""))


@dataclass
class Ratio:
    """``grams``: ``size, gram, d`` (log ratio of the last character given the others); ``contexts``: ``size, context, b`` (log ratio of passing to the shorter one)."""

    order: int
    grams: DataFrame
    contexts: DataFrame
    unseen: float


def learn(urls: DataFrame, order: int = ORDER, share: int = SHARE) -> Ratio:
    """Models of ``text`` by ``accepted`` (boolean)."""
    seen = urls.select("accepted", F.explode(windows("text", order)).alias("w")).groupBy("w").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    size = F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("size")
    counts = seen.select("w", "a", "r", size).groupBy("size", F.expr("right(w, size)").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    counts = write_table(counts, "url-counts")
    total = counts.where("size = 1").agg(F.sum(F.col("a") + F.col("r"))).first()[0] or 0
    kept = counts.where((F.col("a") + F.col("r")) * share >= total).withColumn("context", F.expr("left(gram, size - 1)"))
    contexts = kept.groupBy("size", "context").agg(*[f(c).alias(n + c) for c in "ar" for f, n in ((F.sum, "n"), (lambda x: F.count_if(F.col(x) > 0), "t"))])
    stats = kept.join(contexts, ["size", "context"])
    symbols = kept.where("size = 1").count() + 1
    chain = stats.select("gram", "size", F.explode(F.sequence(F.lit(1), "size")).alias("k")).withColumn("part", F.expr("right(gram, k)"))
    chain = chain.join(stats.select(F.col("gram").alias("part"), F.struct("size", "a", "r", "na", "ta", "nr", "tr").alias("s")), "part")
    chain = chain.groupBy("gram", "size").agg(F.array_sort(F.collect_list("s")).alias("chain"))

    def log_p(c: str) -> Column:
        step = lambda p, s: F.when(s[f"n{c}"] > 0, (s[c] + s[f"t{c}"] * p) / (s[f"n{c}"] + s[f"t{c}"])).otherwise(p)
        return F.log(F.aggregate("chain", F.lit(1.0 / symbols), step))

    passing = lambda c: F.when(F.col(f"n{c}") > 0, F.log(F.col(f"t{c}") / (F.col(f"n{c}") + F.col(f"t{c}")))).otherwise(0.0)
    grams = write_table(chain.select("size", "gram", (log_p("a") - log_p("r")).alias("d")), "url-grams")
    contexts = write_table(contexts.select((F.col("size") - 1).alias("size"), "context", (passing("a") - passing("r")).alias("b")), "url-contexts")
    nothing = contexts.where("size = 0").select("b").first()
    return Ratio(order, grams, contexts, nothing[0] if nothing else 0.0)


def score(urls: DataFrame, model: Ratio) -> DataFrame:
    """``urls`` (all columns, grouped as they are) with ``score``: the mean log ratio of ``text``'s characters and its end."""
    k = model.order
    rest = [c for c in urls.columns if c != "text"]
    w = urls.withColumn("_row", F.monotonically_increasing_id()).select("_row", *rest, F.explode(windows("text", k)).alias("_w"))
    total, passed, found = F.lit(model.unseen), F.lit(0.0), None
    for size in range(k + 1, 0, -1):  # at most SHARE rows a level: see learn()
        level = model.grams.where(F.col("size") == size).select(F.col("gram").alias(f"_g{size}"), F.col("d").alias(f"_d{size}"))
        w = w.join(F.broadcast(level), F.expr(f"right(_w, {size}) = _g{size}"), "left").drop(f"_g{size}")
        d = F.col(f"_d{size}")
        found = F.when(d.isNotNull(), passed + d) if found is None else found.when(d.isNotNull(), passed + d)
        if size > 1:
            level = model.contexts.where(F.col("size") == size - 1).select(F.col("context").alias(f"_c{size}"), F.col("b").alias(f"_b{size}"))
            w = w.join(F.broadcast(level), F.expr(f"substr(_w, {k + 2 - size}, {size - 1}) = _c{size}"), "left").drop(f"_c{size}")
            passed = passed + F.coalesce(f"_b{size}", F.lit(0.0))
    w = w.withColumn("_x", found.otherwise(passed + total))
    return w.groupBy("_row", *rest).agg(F.round(F.sum("_x") / F.count("_x"), 9).alias("score")).drop("_row")


def threshold(scored: DataFrame) -> float:
    """Calibrated threshold of ``score`` by ``accepted`` (null: not for calibration); at most 2 * MOST * BIN sums reach the driver."""
    bins = F.least(F.greatest(F.floor(F.col("score") * BIN), F.lit(-MOST * BIN)), F.lit(MOST * BIN - 1)).alias("bin")
    rows = sorted(tuple(r) for r in scored.where("accepted IS NOT NULL").groupBy(bins).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect())
    a_all, r_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not a_all or not r_all:
        return 0.0
    best, a, r = None, a_all, 0
    for edge, da, dr in [*rows, (MOST * BIN, 0, 0)]:
        best = max(best or (-1,), (a * r_all + r * a_all, -abs(edge), edge))
        a, r = a - da, r + dr
    return best[2] / BIN


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, share: int = SHARE) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``page_id, url``."""
    host, path, text = host_and_path()
    p = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rule, says = rule_of(rules)
    p = p.select("*", rule.alias("rule"), says.alias("says"), (F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int") % 5 == 0).alias("held"))
    accepted = F.col("says") == "allow"
    model = learn(p.where("says IS NOT NULL AND NOT held").select("text", accepted.alias("accepted")), order, share)
    scored = write_table(score(p.select("page_id", "host", "path", "rule", "says", F.when(F.col("held"), accepted).alias("accepted"), "text"), model), "url-scores")
    least = threshold(scored)
    by_model = F.when(F.col("score") >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", by_model).alias("verdict"), F.round("score", 6).alias("score"))


def op13_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by rule or by the models of the ruled ones."""
    return judge(need(table(spark, sf_dir, "pages"), page_id="page_id", url="url"))


def _sql() -> str:
    n = ORDER + 1
    rules = sorted(RULES, key=lambda r: -len(r[0]))

    def fits(text: str) -> str:
        h, _, p = text.partition("/")
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"

    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[what]}'" for r in rules) + " END"
    p_of = lambda c, below: f"CASE WHEN n{c} > 0 THEN (s.{c} + t{c} * {below}) / (n{c} + t{c}) ELSE {below} END"
    levels = f"l1 AS (SELECT gram, {p_of('a', '(SELECT u FROM uniform)')} AS pa, {p_of('r', '(SELECT u FROM uniform)')} AS pr FROM stats s WHERE size = 1)"
    for k in range(2, n + 1):
        levels += f",\nl{k} AS (SELECT s.gram, {p_of('a', 'pa')} AS pa, {p_of('r', 'pr')} AS pr FROM stats s JOIN l{k - 1} q ON q.gram = right(s.gram, {k - 1}) WHERE size = {k})"
    joins = "".join(f" LEFT JOIN l{k} ON l{k}.gram = right(w, {k})" for k in range(1, n + 1))
    joins += "".join(f" LEFT JOIN b c{k} ON c{k}.size = {k} AND c{k}.context = substr(w, {n - k}, {k})" for k in range(1, n))
    passed, found = "0.0", "CASE"
    for k in range(n, 0, -1):
        found += f" WHEN l{k}.gram IS NOT NULL THEN {passed} + ln(l{k}.pa) - ln(l{k}.pr)"
        passed += f" + coalesce(c{k - 1}.b, 0.0)" if k > 1 else ""
    found += f" ELSE {passed} + coalesce((SELECT b FROM b WHERE size = 0), 0.0) END"
    return f"""
WITH u AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS sep FROM pages),
v AS (SELECT *, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM u),
x AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM v),
h AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS after FROM x),
t AS (SELECT *, regexp_extract(after, '^[^?#]*') AS path, CASE WHEN sep > 0 THEN host || after ELSE url END AS text FROM h),
p AS (SELECT id, page_id, host, path, text, {case(0)} AS rule, {case(1)} AS says, CAST('0x' || md5(text)[1:4] AS BIGINT) % 5 = 0 AS held FROM t),
w AS (SELECT *, substr(repeat(chr(2), {ORDER}) || text || chr(3), i, {n}) AS w FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM p)),
counts AS (SELECT size, right(w, size) AS gram, count(*) FILTER (WHERE says = 'allow') AS a, count(*) FILTER (WHERE says = 'block') AS r
           FROM (SELECT *, unnest(range(1, {n + 1})) AS size FROM w WHERE says IS NOT NULL AND NOT held) GROUP BY ALL),
kept AS (SELECT *, left(gram, size - 1) AS context FROM counts WHERE (a + r) * {SHARE} >= (SELECT sum(a + r) FROM counts WHERE size = 1)),
c AS (SELECT size, context, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr FROM kept GROUP BY ALL),
stats AS (SELECT kept.*, na, nr, ta, tr FROM kept JOIN c USING (size, context)),
uniform AS (SELECT 1.0 / (count(*) + 1) AS u FROM kept WHERE size = 1),
b AS (SELECT size - 1 AS size, context, CASE WHEN na > 0 THEN ln(ta / (na + ta)) ELSE 0.0 END - CASE WHEN nr > 0 THEN ln(tr / (nr + tr)) ELSE 0.0 END AS b FROM c),
{levels},
scored AS (SELECT id, round(avg({found}), 9) AS score FROM w{joins} GROUP BY id),
f AS (SELECT p.*, score FROM p JOIN scored USING (id)),
bins AS (SELECT least(greatest(floor(score * {BIN}), {-MOST * BIN}), {MOST * BIN - 1}) AS bin, count(*) FILTER (WHERE says = 'allow') AS a, count(*) FILTER (WHERE says = 'block') AS r
         FROM f WHERE held AND says IS NOT NULL GROUP BY ALL UNION ALL SELECT {MOST * BIN}, 0, 0),
sums AS (SELECT bin, sum(a) OVER () AS aa, sum(r) OVER () AS rr, sum(a) OVER (ORDER BY bin DESC) AS a, sum(r) OVER (ORDER BY bin) - r AS r FROM bins),
least_score AS (SELECT CASE WHEN aa = 0 OR rr = 0 THEN 0.0 ELSE bin / {BIN} END AS edge FROM sums ORDER BY a * rr + r * aa DESC, abs(bin), bin DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= (SELECT edge FROM least_score) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM f
"""


OP13_SQL = _sql()
