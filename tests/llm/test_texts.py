"""Operators on documents against brute force, on odd rows and on the smallest driver table."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvio.llm import decontaminate, exact_dedup, jaccard, katz, mixing, quality, sharding, token_count, toxicity
from fluvio.llm import words as W

from .conftest import odd_rows, sentence


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lower_words(text):
    return (text or "").encode().lower().split()


# --- hashing ---------------------------------------------------------------------------------------

def test_words_and_packing():
    texts = [t for _, t, _ in odd_rows()]
    h, at = W.word_hashes(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    words = [lower_words(t) for t in texts]
    assert list(np.diff(at)) == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))
    for a in (np.zeros(0, np.uint64), np.sort(h), h[:1]):
        assert (W.unpack(W.pack(a)) == a).all() and (W.unpack_sorted(W.pack_sorted(np.sort(a))) == np.sort(a)).all()


# --- op1 -------------------------------------------------------------------------------------------

def katz_by_hand(rows):
    texts = [lower_words(t) + [None] for _, t, _ in rows]
    train = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _, _ in rows]
    one, two, ctx = Counter(), Counter(), Counter()
    for w, f in zip(texts, train):
        if f:
            before = ["BEGIN", *w[:-1]]
            one.update(w), two.update(zip(before, w)), ctx.update(before)
    n, v = sum(one.values()), len(one)
    d1, d2 = (katz.good_turing([list(c.values()).count(r) for r in range(1, katz.K + 2)]) for c in (one, two))
    cut = lambda d, c: d[min(c, katz.K + 1)] * c
    kept = sum(cut(d1, c) for c in one.values())
    z = n if n - kept > 1e-9 else n + 1
    p1 = lambda w: cut(d1, one[w]) / z if one[w] else 1 - kept / z
    mass, seen = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        mass[h] += cut(d2, c)
        seen[h] += p1(w)
    zh = {h: c if c - mass[h] > 1e-9 else c + 1 for h, c in ctx.items()}
    p = lambda h, w: cut(d2, two[h, w]) / zh[h] if two[h, w] else ((1 - mass[h] / zh[h]) / (1 - seen[h]) if h in zh else 1.0) * p1(w)
    for h in list(zh)[:20]:  # exactly normalised: known words and the unknown one
        assert abs(sum(p(h, w) for w in one) + (1 - mass[h] / zh[h]) / (1 - seen[h]) * (1 - kept / z) - 1) < 1e-9
    return n, [(d, f, len(w), sum(one[x] > 0 for x in w), sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w),
                sum(math.log10(p(h, x)) for h, x in zip(["BEGIN", *w[:-1]], w))) for (d, _, _), w, f in zip(rows, texts, train)]


@pytest.mark.parametrize("heads", [1, 30, 1 << 20])  # no, some and all words broadcast
def test_katz_against_brute_force(odd, heads):
    train = ~quality.held_out("doc_id", 7, 2)
    model, tables = katz.fit(odd, train, heads=heads, part_bytes=50_000)
    got = katz.score(odd, model, tables, train).select("doc_id", "train", "n_tokens", "n_known", F.col("base") - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1)), "score")
    n, want = katz_by_hand(odd_rows())
    assert model.tokens == n
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_katz_without_rows_or_training(odd, none):
    train = ~quality.held_out("doc_id", 7, 2)
    model, tables = katz.fit(none, train)
    assert katz.score(none, model, tables, train).count() == 0
    scored = katz.score(odd, model, tables, train)
    assert scored.count() == len(odd_rows()) and scored.where("score <> 0 OR n_known <> 0").count() == 0


# --- op2 -------------------------------------------------------------------------------------------

def test_exact_groups_against_brute_force(odd, none):
    got = exact_dedup.exact_groups(odd)
    groups = defaultdict(list)
    for d, t, _ in odd_rows():
        groups[(t or "").encode().lower()].append(d)
    want = []
    for norm, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            want.append((d, keep, len(ids), d == keep and left > 0, hashlib.sha256(norm).hexdigest()))
            left -= d == keep
    assert rows_of(got) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(none).count() == 0


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    fp = np.concatenate((fp, fp[:700], fp[:40], np.zeros(9, np.uint64), np.full(3, 2**64 - 1, np.uint64)))
    rng.shuffle(fp)
    parts = [exact_dedup.QuotientFilter.load(exact_dedup.QuotientFilter.build(p).dump()) for p in np.array_split(fp, 7)]
    pieces = defaultdict(list)
    for f in parts:
        for r, piece in f.ranges(8):
            pieces[r].append(piece)
    merged = [exact_dedup.QuotientFilter.merge(p) for _, p in sorted(pieces.items())]
    u, n = np.unique(fp, return_counts=True)
    assert (np.concatenate([m.fingerprints() for m in merged]) == u).all()
    assert (np.concatenate([m.counts for m in merged]).astype(int) == n).all()


# --- op3 -------------------------------------------------------------------------------------------

def targets_by_hand(size, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * size[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * size[s] * (1 + 1e-12)}
        if not over:
            return {s: cap * size[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mix_against_brute_force(spark, odd, none, sf_small):
    big = spark.read.parquet(f"{sf_small}/documents.parquet")
    for docs, near in ((odd, 0.5), (big, 0.06)):
        got = mixing.choose(mixing.measured(docs.select("doc_id", "text", "source")).drop("text")).collect()
        texts = docs.select("text", "source").collect()
        size = defaultdict(int)
        for r in texts:
            size[r.source] += len((r.text or "").encode().split())
        want = targets_by_hand(size)
        taken = defaultdict(int)
        for r in got:
            assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
            assert 0 <= r.copies <= 3
            taken[r.source] += r.size * r.copies
        assert len(got) == len(texts) and sum(want.values()) == pytest.approx(sum(size.values()))
        largest = defaultdict(int)
        for r in got:
            largest[r.source] = max(largest[r.source], r.size)
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(near * t, 0.5 * largest[s] + 1)
    assert mixing.choose(mixing.measured(none.select("doc_id", "text", "source"))).count() == 0
    again = mixing.repeat_to_mix(odd)
    assert again.columns == odd.columns and rows_of(again) == rows_of(mixing.repeat_to_mix(odd.repartition(5)))


def test_dual_with_base_rates_and_cap(spark):
    cells = spark.createDataFrame([("a", 0.5, 100.0), ("a", 2.0, 50.0), ("b", 1.0, 10.0)], "source string, base double, size double")
    targets = spark.createDataFrame([("a", 150, 300.0), ("b", 10, 30.0)], "source string, source_size long, target double")
    dual = {r.source: r.dual for r in mixing.solve_dual(cells, targets).collect()}
    a = math.exp(dual["a"])
    assert 100 * min(3, 0.5 * a) + 50 * min(3, 2 * a) == pytest.approx(300, rel=1e-9)
    assert math.exp(dual["b"]) == pytest.approx(3, rel=1e-9)


def test_rates_tilt_with_size_and_solve_the_dual(spark):
    """Rates differ within a source, meet the targets, and are the brute-force optimum of the dual (bisection)."""
    import random
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * max(1, int(rng.lognormvariate(3, 1)))), "abcd"[min(3, i // 150)]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.choose(mixing.measured(docs).drop("text")).collect()
    for s in "abcd":
        mine = [r for r in got if r.source == s]
        size, target = sum(r.size for r in mine), mine[0].target
        by_class = defaultdict(list)
        for r in mine:
            by_class[math.floor(math.log2(r.size) * mixing.CLASSES)].append(r.size)
        mean = size / len(mine)
        u = {c: sum(x) / len(x) / mean for c, x in by_class.items()}
        words = lambda lam: sum(sum(x) * min(3, math.exp(min(50, lam * u[c]))) for c, x in by_class.items())
        if target >= 3 * size * (1 - 1e-9):
            assert all(r.rate == pytest.approx(3) for r in mine)
            continue
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
        rates = {math.floor(math.log2(r.size) * mixing.CLASSES): r.rate for r in mine}
        assert all(rates[c] == pytest.approx(min(3, math.exp(min(50, lo * u[c]))), rel=1e-6) for c in u)
        assert words(lo) == pytest.approx(target, rel=1e-9) and (len({round(x, 6) for x in rates.values()}) > 1 or abs(lo) < 1e-6)


def test_many_sources_are_ranked_in_ranges(spark):
    size = {(None if i == 7 else f"s{i:03d}"): 1 + (i * 37) % 91 for i in range(200)}
    df = spark.createDataFrame(list(size.items()), "source string, size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets_by_hand(size)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_long_items_cost_few_hits(spark):
    """A document equal to a long item, with and without changed words: equal results, and hits that do not grow with the length."""
    import random
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    changed = list(item)
    for k in range(5, 600, 40):
        changed[k] = "other"
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(changed)), (3, " ".join(["x"] * 9 + item[100:140])), (4, " ".join(item[::-1]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.matched, r.compared, r.doc_start) for r in decontaminate.overlaps(docs, items).collect()}
    assert got[1] == (600, 600, 0) and got[2] == (585, 600, 0) and got[3][0] == 40 and 4 not in got
    hashed = lambda df, c: df.select("*", decontaminate.word_array(F.col("text")).alias(c)).withColumn("hs", F.transform(c, lambda w: F.xxhash64(w)))
    known = decontaminate.seeds(hashed(items, "words").withColumnRenamed("words", "words"), decontaminate.MASKS, items=True).select("seed", F.col("pos").alias("item_pos"), F.col("words").alias("item"))
    hits = decontaminate.seeds(hashed(docs, "words"), decontaminate.MASKS).drop("hs").join(known, "seed").where(~decontaminate.goes_on(decontaminate.MASKS))
    n = {r.doc_id: r["count"] for r in hits.groupBy("doc_id").count().collect()}
    assert n[1] <= 3 and n[2] <= 3 * 16 * 4


def test_one_keeper_among_many_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "same")] * 50 + [(None, "other"), (3, "third"), (3, "third"), (2, "third")], "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_groups(docs).collect()
    kept = sorted((r.text_sha256, r.doc_id, r.group_size) for r in got if r.kept)
    assert len(got) == 54 and len(kept) == 3 and sorted(k[2] for k in kept) == [1, 3, 50]


def test_equal_rows_without_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, "same")] * 5000 + [(i, "x") for i in range(100)], "doc_id long, text string").repartition(8)
    got = sharding.sharded(docs)
    rows = got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d")).collect()
    assert len(rows) == 40 and all(r.n in (127, 128) and r["last"] == r.n - 1 and r.d == r.n for r in rows)


# --- op4 -------------------------------------------------------------------------------------------

def test_shards_are_even_gapless_and_repeatable(odd, none, spark, sf_small):
    for docs in (odd, spark.read.parquet(f"{sf_small}/documents.parquet")):
        got = sharding.sharded(docs, shards=7, nodes=16).collect()
        texts = docs.select("doc_id", "text").collect()
        assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
            (repr(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in texts)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(7)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert sorted(map(repr, got)) == sorted(map(repr, sharding.sharded(docs.repartition(5), shards=7, nodes=16).collect()))
    assert sharding.sharded(none).count() == 0


def test_walk_goes_clockwise_and_keeps_bounds():
    pieces = sharding.walk([5, 0, 3, 4], [0, 1, 2, 1], [3, 4, 5])
    assert pieces[0] == [(0, 3, 0, 0), (3, 5, 2, 3)]  # node 0 is full after 3; shard 1 has given its room to node 3, so shard 2 is next
    assert pieces[2] == [(0, 3, 2, 0)] and pieces[3] == [(0, 4, 1, 0)] and not pieces[1]
    few = sharding.capacities(10, 4)
    assert few == [3, 3, 2, 2]
    assert sharding.capacities(100, 4, 0.1) == [28] * 4  # 100 * 1.1 / 4 rounded up


def test_ring_row_by_row(spark):
    """Every row's shard and slot by a plain walk: its ring point, the nodes clockwise, the room of their shards."""
    shards, nodes = 5, 8
    docs = spark.range(300).select((F.col("id") * 7 % 211).alias("doc_id"), F.lit("t").alias("text"), F.col("id").alias("nr"))
    key = F.xxhash64("doc_id")
    for slack in (0.0, 0.3):
        got = {r.nr: (r.shard, r.slot) for r in sharding.on_ring(docs, key, [F.col("doc_id"), F.col("nr")], shards, nodes, slack).collect()}
        ring = sharding.node_ring(spark, shards, nodes)
        room = sharding.capacities(300, shards, slack)
        rows = sorted((r.at, r.doc_id, r.nr) for r in docs.select("doc_id", "nr", F.shiftrightunsigned(key, 2).alias("at")).collect())
        owner = lambda at: next((i for i, (p, _) in enumerate(ring) if p >= at), 0)
        by_node = defaultdict(list)
        for at, _, nr in rows:
            by_node[owner(at)].append(nr)
        # Each key stays with its own node's shard while that has room; the others go on clockwise from there.
        own = Counter(ring[n][1] for n, x in by_node.items() for _ in x)
        taken = Counter(s for s, _ in got.values())
        assert all(taken[s] <= room[s] for s in range(shards)) and sum(taken.values()) == 300
        assert all(sorted(x for s2, x in got.values() if s2 == s) == list(range(taken[s])) for s in range(shards))
        for n, x in by_node.items():
            shard = ring[n][1]
            moved = [nr for nr in x if got[nr][0] != shard]
            if own[shard] <= room[shard] and slack == 0.3:
                assert not moved  # nobody leaves a shard that has room for all its own
            if moved:
                assert taken[shard] == room[shard]  # only a full shard sends keys on
            for nr in moved:  # and those it sends on pass only shards that end up full
                k = (n + 1) % len(ring)
                while ring[k][1] != got[nr][0]:
                    assert taken[ring[k][1]] == room[ring[k][1]]
                    k = (k + 1) % len(ring)


def test_little_moves_with_slack(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    key = F.xxhash64("doc_id")
    at = {n: {r.doc_id: r.shard for r in sharding.on_ring(docs, key, [F.col("doc_id")], n, 64, 0.25).collect()} for n in (10, 11)}
    moved = sum(at[10][d] != at[11][d] for d in at[10])
    assert moved < 0.3 * 4000  # dealing by remainder would move ten in eleven


# --- op5 -------------------------------------------------------------------------------------------

def components_by_hand(rows, n=5, percent=80):
    sets = []
    for _, t, *_ in rows:
        w = lower_words(t)
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for a, b in {(ids[x], ids[y]) for ids in where.values() for y in range(len(ids)) for x in range(y)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(ids[find(i)], default=None)) for i, r in enumerate(rows)]


def test_jaccard_against_brute_force(odd, none, spark, sf_small):
    big = spark.read.parquet(f"{sf_small}/documents.parquet")
    for docs in (odd, big):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = jaccard.similar(docs).select("doc_id", "n_shingles", "component_id")
        assert rows_of(got) == sorted(components_by_hand(rows), key=repr)
    assert jaccard.similar(none).count() == 0


def test_jaccard_chains_and_apart_groups(spark):
    """A chain whose ends are not similar, and many texts that share their rarest n-grams without being similar."""
    import random
    rng = random.Random(1)
    words = sentence(rng, 120).split()
    rows, now = [], list(words)
    for i in range(8):
        rows.append((i, " ".join(now)))
        now[10 * i + 3] = f"new{i}"
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows += [(50, f"{a} {b}"), (51, f"{a} {c}"), (52, f"{b} {a}"), (53, f"{c} {b}"), (54, f"{a} {b} end"), (55, f"{c} {b} end")]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(components_by_hand(rows), key=repr)


def test_jaccard_star_of_copies(spark, monkeypatch):
    """Copies that are similar to their base but not to one another, over many partitions; rounds and the exact end agree."""
    import random
    rng = random.Random(2)
    base = sentence(rng, 200).split()
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(200), 5):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = sorted(components_by_hand(rows), key=repr)
    for few in (3, 10**9):
        monkeypatch.setattr(jaccard, "FEW", few)
        assert rows_of(jaccard.similar(docs).select("doc_id", "n_shingles", "component_id")) == want


def test_prefix_tree_counts_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(80)]
    probe = sets[7]
    want = {i: len(np.intersect1d(s, probe)) for i, s in enumerate(sets)}
    for least in (1, 5, 12):
        got = dict(jaccard.PrefixTree(sets).overlaps(probe, np.full(80, least)))
        assert got == {i: k for i, k in want.items() if k >= least}


def test_keep_first_keeps_one_row_of_each_group(odd, none):
    got = jaccard.keep_first(odd)
    assert got.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    rows = [(d, t) for d, t, _ in odd_rows()]
    want = {(c, n) for _, n, c in components_by_hand(rows) if c is not None}
    assert sorted(d for d, _ in kept if d is not None) == sorted(c for c, _ in {(c, 0) for c, _ in want})
    assert (None, None) in kept and (None, "Alone with no id") in kept
    assert jaccard.keep_first(none).count() == 0


def test_keep_first_tells_components_apart_without_ids(spark):
    import random

    rng = random.Random(23)
    a, b, c, d, e = (sentence(rng, 60) for _ in range(5))
    near = " ".join(x if k != 30 else "changed" for k, x in enumerate(b.split()))
    rows = [(None, a, 1), (None, a, 2), (None, a.upper(), 3), (None, b, 4), (None, near, 5), (7, c, 6), (7, d, 7), (7, d, 8), (8, d, 9), (None, e, 10), (9, e, 11), (None, "", 12), (None, "", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(3)
    kept = [r["at"] for r in jaccard.keep_first(docs).collect()]
    groups = [{1, 2, 3}, {4, 5}, {6}, {7, 8}, {11}, {12}, {13}]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups)


# --- op6 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("heads", [1, 50, 1 << 20])
def test_token_counts_equal_the_library(spark, odd, none, heads):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = [(200, "<|endoftext|> a<|endoftext|>  b"), (201, "don't we'll 12 34\n\n  x y  z"), (202, "日本語 emoji 🙂🙂 ½")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("h", F.lit(1))
    got = token_count.token_counts(docs, path, heads=heads)
    want = []
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert rows_of(got) == sorted(want, key=repr)
    assert token_count.token_counts(none, path).count() == 0


# --- op7 -------------------------------------------------------------------------------------------

def test_spaced_seeds_find_substituted_passages(spark, odd, none):
    import random
    rng = random.Random(9)
    items = [(i, sentence(rng, 14 + 4 * i)) for i in range(10)] + [(90, None), (91, ""), (92, "too short"), (93, sentence(rng, 8))]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    rows, want = [(1, None), (2, ""), (3, sentence(rng, 400))], set()
    for i, t in items[:10]:
        w = t.split()
        changed = [x if k % 7 != 5 else "other" for k, x in enumerate(w)]
        half = w[:len(w) // 2 + 1] if len(w) > 28 else w
        for j, inner in enumerate((w, changed, half, [x.upper() + "," for x in w])):
            rows.append((10 * i + 100 + j, f"{sentence(rng, 30)} {' '.join(inner)} {sentence(rng, 30)}"))
            want.add((10 * i + 100 + j, i))
        rows.append((10 * i + 109, " ".join(x if k % 3 else "no" for k, x in enumerate(w))))  # a third differs: not the passage
    rows += [(300, items[13][1]), (None, items[3][1]), (400, rows[4][1]), (400, rows[4][1])]
    want |= {(300, 93), (None, 3), (400, 0)}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")
    got = decontaminate.overlaps(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    blocks = decontaminate.overlaps(docs, bench, block_seeds=200)
    assert rows_of(blocks) == rows_of(got)
    stay = decontaminate.clean(docs, bench)
    bad = {d for d, _ in want if d is not None}
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(d for d, _ in rows if d is not None and d not in bad)
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_spaced_seeds_find_items_of_any_length_and_id(spark):
    import random

    rng = random.Random(31)
    items = [(n, " ".join(f"item{n}w{k}" for k in range(n))) for n in range(1, 14)]
    items += [(5, "same id other text of the item five"), (None, "no id but a passage of some words here"), (None, "a second item with no id"), (None, "a second item with no id")]
    rows, want = [], set()
    for number, (i, t) in enumerate(items[:-1]):
        w = t.split()
        for at in (None, *range(len(w))):
            d = 100 * number + (0 if at is None else at + 1)
            rows.append((d, f"{sentence(rng, 9)} {' '.join('other' if k == at else x for k, x in enumerate(w))} {sentence(rng, 9)}"))
            if at is None or len(w) > 6:
                want.add((d, i))
    rows.append((5000, f"{items[4][1]} {items[13][1]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted([*want, (5000, 5), (5000, 5)], key=repr)
    blocks = decontaminate.overlaps(docs, bench, block_seeds=300)
    assert sorted(((r.doc_id, r.item_id) for r in blocks.collect()), key=repr) == sorted(got, key=repr)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == sorted({d for d, _ in rows} - {d for d, _ in got})


def test_spaced_seeds_do_not_depend_on_pieces(spark):
    import random
    rng = random.Random(11)
    items = [(i, sentence(rng, n)) for i, n in enumerate((3, 8, 9, 14, 25, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, None), (1, ""), (2, " ".join(t for _, t in items)), (3, " ".join(["same"] * 120))]
    for at in range(0, 130, 3):
        rows.append((100 + at, f"{sentence(rng, at)} {rng.choice(items)[1]} {sentence(rng, 130 - at)} {' '.join(rng.choice(items)[1].split()[1:])}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = rows_of(decontaminate.overlaps(docs, bench, piece_words=1))
    assert len(small) > 60 and small == rows_of(decontaminate.overlaps(docs, bench, piece_words=1 << 20)) == rows_of(decontaminate.overlaps(docs, bench))


LONG_DOCUMENTS = """
import random, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1",
    "spark.checkpoint.dir": sys.argv[1], "spark.local.dir": sys.argv[1], "spark.sql.warehouse.dir": sys.argv[1] + "/tables"}).getOrCreate()
from fluvio.llm import decontaminate
rng = random.Random(1)
passage = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
items = [passage(30) for _ in range(50)]
docs = [(d, " ".join(passage(370) + " " + items[(d + k) % 50] for k in range(50))) for d in range(4)]
spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(sys.argv[1] + "/docs")
found = decontaminate.overlaps(spark.read.parquet(sys.argv[1] + "/docs"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
print("found", found.where("matched = 30").count())
"""


def test_spaced_seeds_of_long_documents_need_little_memory(tmp_path):
    """Documents of 20,000 words with 50 passages each: a hit must not take the whole document along."""
    import os
    import subprocess
    import sys
    from pathlib import Path
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell", "PYTHONPATH": str(Path(decontaminate.__file__).parents[2]), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", LONG_DOCUMENTS, str(tmp_path)], env=env, capture_output=True, text=True, timeout=240)
    assert "found 200" in done.stdout, done.stderr[-2000:]


# --- op8 -------------------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, 0), (9, 1), (9, 0), (None, 1), (10, None), (999, 1)], "doc_id long, quality int")
    got = quality.quality_scores(odd, labels)
    assert got.count() == len(odd_rows()) and got.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.quality_scores(odd, labels.limit(0)).where("score <> 0.5").count() == 0
    kept = quality.keep_good(spark, odd, labels.limit(0), threshold=0.5)
    assert rows_of(kept) == rows_of(odd)
    assert quality.keep_good(spark, none, labels).count() == 0


def test_flattened_trees_fit_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_trees(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    one = quality.fit_trees(x[:10], np.ones(10))
    assert (one.score(x) > 0.99).all() and (quality.fit_trees(x[:0], y[:0]).score(x) == 0.5).all()


def test_trees_against_plain_splits():
    """Boosting with every split searched by sums over rows, and every tree walked row by row."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 4)), 1).astype(np.float32)  # ties and repeated values
    y = ((x[:, 0] + 0.5 * x[:, 2] > 0.2) ^ (rng.random(240) < 0.1)).astype(float)
    params = dict(trees=6, depth=3, rate=0.3, bins=8, l2=2.0)
    model = quality.fit_trees(x, y, **params)
    edges = [sorted({np.float32(v) for v in np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])}) for j in range(4)]
    p0 = (y.sum() + 0.5) / 241
    margin, grown = [math.log(p0 / (1 - p0))] * 240, []

    def gain_of(g, s, left):
        gl, sl = sum(g[i] for i in left), sum(s[i] for i in left)
        return gl, sl

    for _ in range(6):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        g, s = [a - b for a, b in zip(q, y)], [a * (1 - a) for a in q]

        def grow(rows, depth):
            if depth == 3:
                return -0.3 * sum(g[i] for i in rows) / (sum(s[i] for i in rows) + 2.0)
            all_g, all_s = gain_of(g, s, rows)
            best = (1e-6, None)
            for j in range(4):
                for e in edges[j]:
                    left = [i for i in rows if x[i, j] <= e]
                    gl, sl = gain_of(g, s, left)
                    if sl >= 2 and all_s - sl >= 2:
                        gain = gl**2 / (sl + 2) + (all_g - gl)**2 / (all_s - sl + 2) - all_g**2 / (all_s + 2)
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, e))
            if best[1] is None:
                return grow(rows, depth + 1)  # no split: all rows go left
            j, e = best[1]
            return j, e, grow([i for i in rows if x[i, j] <= e], depth + 1), grow([i for i in rows if x[i, j] > e], depth + 1)

        tree = grow(list(range(240)), 0)
        grown.append(tree)

        def walk(row, t):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        margin = [m + walk(x[i], tree) for i, m in enumerate(margin)]
    want = [1 / (1 + math.exp(-m)) for m in margin]
    assert np.allclose(model.score(x), want, atol=1e-9)
    fresh = rng.normal(size=(50, 4)).astype(np.float32)
    base = math.log(p0 / (1 - p0))
    assert np.allclose(model.score(fresh), [1 / (1 + math.exp(-(base + sum(walk(r, t) for t in grown)))) for r in fresh], atol=1e-9)


# --- op9 -------------------------------------------------------------------------------------------

def test_toxicity_restores_and_scores(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")).where(~quality.held_out("doc_id", 5, 0)))
    clean = "and this with of the and was then of it"
    for plain, hidden in (("stupid", "$tup1d"), ("idiot", "1d10t"), ("stupid", "stuuuupid"), ("worthless", "w0rthl3ss"), ("pathetic", "p.a.t.h.e.t.i.c"), ("loser", "l o s e r")):
        restored = toxicity.words(f"{clean} {hidden} {clean}", model.channel)[1]
        assert plain in restored, (hidden, restored)
        strong = model.evidence(f"{clean} {hidden} {clean}")
        assert strong[0] > 0 and model.score(np.array([strong]))[0] > model.score(np.array([model.evidence(clean)]))[0]
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9 and got.score.between(0, 1).all()


def test_toxicity_restores_long_and_unusual_disguises(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    channel = toxicity.Channel.learned(toxicity.letter_counts(docs))
    clean = "and this with of the and was then of it"
    for plain, hidden in (
        ("stupid", "stu" + 40 * "u" + "pid"), ("worthless", "w...o...r...t...h...l...e...s...s"), ("trash", "tr@sh.you"), ("loser", "you,l0ser,go"),
        ("loser", "l\to\n s  e\u00a0r"), ("loser", "l\no\ns\ne\nr"), ("stupid", "l o s e r   s t u p i d"), ("idiot", "1" + 3000 * "-" + "d10t"),
    ):
        restored = toxicity.words(f"{clean} {hidden} {clean}", channel)[1]
        assert plain in restored, (hidden, restored)
    for token in ("https://st0p.example/l0ser", "9233a8ecf7c5b09fe594"):
        assert not toxicity.words(token, channel)[1]


def test_toxicity_weighs_every_feature(spark):
    """A rare but purely toxic word counts however many neutral words are more frequent, broadcast or joined."""
    neutral = [f"neutral{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(neutral) + f" {'zonk' if i < 40 else 'fine'} x{chr(97 + i % 26)}{chr(97 + i // 26)}", int(i < 80)) for i in range(400)]
    rows += [(1000, "z0nk you", None), (1001, "a b z o n k i s c d", None), (1002, " ".join(neutral), None), (1003, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    got = {}
    for most in (1 << 18, 0):
        model = toxicity.fit(docs.drop("label"), docs.select("doc_id", "label"), broadcast_features=most)
        assert (model.table is None) == (most > 0)
        weights = model.weights if most else {r.f: r.w for r in model.table.collect()}
        assert weights["zonk"] > 1.5 and not any(f.startswith("neut") for f in weights)
        out = toxicity._evidence(toxicity._rows(docs), model, "doc_id")
        got[most] = {r.doc_id: (r.strongest, r.words, r.share, round(r.score, 9)) for r in out.collect()}
        assert got[most][1000][0] > 0 and got[most][1001][0] > 0 and got[most][1002][0] == got[most][1003][0] == 0
    assert got[0] == got[1 << 18] and len(got[0]) == len(rows)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 1), (9, 0), (None, 1), (10, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd, labels)
    assert got.count() == len(odd_rows()) and got.where("score IS NULL OR predicted IS NULL").count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(odd, labels.limit(0)).where("abs(score - 0.5) > 1e-9").count() == 0


def test_viterbi_equals_exhaustive_search():
    from itertools import product

    rng = np.random.default_rng(4)
    channel = toxicity.Channel(np.log(rng.dirichlet(np.ones(toxicity._N), (toxicity._N, toxicity._N))).astype(np.float32))

    def cost(word):
        a = b = 0
        total = 0.0
        for k in [toxicity._INDEX[c] for c in word] + [0]:
            total += float(channel.logs[a, b, k])
            a, b = b, k
        return total

    for token in ("1d10t", "ssstup1d", "a-1-b", "b@11", "x"):
        paths = [("".join(x for x, _ in p), sum(c for _, c in p)) for p in product(*toxicity.lattice(token))]
        best = max(paths, key=lambda p: cost(p[0]) + p[1])
        assert channel.restore(token) == best[0]


def test_template_pages_form_few_pairs(spark, monkeypatch):
    """1,000 different pages of one template, each there twice: their template n-grams make no pairs."""
    import random
    rng = random.Random(4)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(1000):
        at, own = rng.randrange(121), [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 40))]
        rows += [(2 * i + k, " ".join(template[:at] + own + template[at:])) for k in range(2)]
    formed, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (formed.append(pairs.count()), verified(pairs, *a))[1])
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(d, d - d % 2) for d, _ in rows}
    assert sum(formed) <= len(rows)


def test_hot_ngrams_within_and_across_blocks(spark, monkeypatch):
    """N-grams that many documents of a block have, of one block and of all: equal to brute force with small blocks."""
    import random
    rng = random.Random(9)
    line = sentence(rng, 12)
    rows = [(i, f"{line} {sentence(rng, 3 + i % 5)} {line if i % 3 else ''}") for i in range(60)] + [(100 + i, rows_text) for i, rows_text in enumerate([line] * 7)]
    rows += [(200 + i, f"{line} {line} {'x y z' if i % 2 else 'x y'}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.similar(docs).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == sorted(components_by_hand(rows), key=repr)
