"""Lexical search against a plain scorer and the registered SQL; bounds of the tree."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from fluvio.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(items, docs, top=20):
    tf = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    n_all, l_all = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item_id, text in set(items):
        want = Counter(words(text))
        rows = []
        for (d, _), c, size in zip(docs, tf, n):
            m = 75 + (25 * size * n_all) // max(l_all, 1)
            s = sum(k * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in want.items() if t in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(item_id, text, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows, key=lambda r: r[:3])[:top])]
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(400)] + ["Été", "東京", "naïve", "X1"]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!", "\t\n"]) for _ in range(k))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(n)]
    docs += [(1000 + i, docs[3][1].upper()) for i in range(60)] + [(None, docs[3][1]), (None, docs[4][1]), (None, None), (2000, None), (2001, ""), (2002, " .,! "), (7, docs[7][1]), (7, docs[7][1]), (2003, text(5000))]
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, docs[3][1] + " " + docs[3][1]), (50, "w1 w1 w2"), (None, "w3 w4"), (51, None), (52, ""), (53, "unseenword"), (50, "w1 w1 w2")]
    return items, docs


def frames(spark, items, docs):
    return (spark.createDataFrame([(*r, 9, "k") for r in items], "item_id long, text string, score long, key string"),
            spark.createDataFrame([(*r, 9, "k", 1) for r in docs], "doc_id long, text string, n long, term string, rank int").repartition(4))


@pytest.mark.parametrize("block,tree", [(L.BLOCK_BYTES, L.TREE), (150, 16)])
def test_against_a_plain_scorer(spark, block, tree):
    items, docs = corpus(300)
    got = [tuple(r) for r in L.search(*frames(spark, items, docs), block_bytes=block, tree=tree).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(got, key=key) == sorted(by_hand(items, docs), key=key)


def test_empty_tables(spark):
    items, docs = frames(spark, *corpus(20))
    assert L.search(items, docs.limit(0)).count() == 0 and L.search(items.limit(0), docs).count() == 0


def test_bounds_are_never_under_a_score_and_prune(monkeypatch):
    """At every node the bound is no less than any score below; far fewer leaves than documents are scored."""
    rng = np.random.default_rng(4)
    terms, docs = 300, 2000
    weight = np.sort(rng.integers(1, 8000, terms))
    popularity = 1 / (np.arange(terms) + 3)
    draw = lambda k: np.unique(rng.choice(terms, k, p=popularity / popularity.sum()))
    vectors = [(t, rng.integers(1, 5, len(t))) for t in (draw(rng.integers(1, 25)) for _ in range(docs))]
    m = rng.integers(75, 400, docs)
    items = L.Items([Counter(dict.fromkeys(draw(12).tolist(), 1)) for _ in range(30)], weight)
    tree = L.Tree([(i, 0) for i in range(docs)], m, vectors)
    alive = np.arange(items.count)
    exact = np.array([items.scores(np.array(p), L.parts(tree.tf[a:b], k), alive) for p, a, b, k in zip(tree.path, tree.at[:-1], tree.at[1:], tree.m)])
    stack, leaves = [tree.node(0, len(tree.leaves), 0)], 0
    while stack:
        lo, hi, depth, t, f, least_m, least = stack.pop()
        assert (items.scores(t, L.parts(f, least_m), alive) >= exact[lo:hi].max(axis=0)).all()
        assert least == min(d[0][0] for d in tree.docs[lo:hi])
        if hi - lo > 1:
            below = list(tree.children(lo, hi, depth))
            assert [b[0] for b in below] == [lo, *[b[1] for b in below[:-1]]] and below[-1][1] == hi
            stack.extend(below)
        else:
            leaves += 1
    assert leaves == len(tree.leaves)
    best, scored = L.Best(items.count, 5), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda *a: (scored.append(a), add(*a)))
    tree.search(items, best)
    for i in range(items.count):
        want = sorted((-int(s), d[0]) for s, x in zip(exact[:, i], tree.docs) for d in x if s > 0)[:5]
        assert sorted(r[:2] for r in best.rows[i])[:5] == want
    assert len(scored) < 0.5 * (exact > 0).sum()


def test_query_equals_sql(spark, tmp_path):
    items, docs = corpus(150, 8)
    items = [r for r in items if r != (50, "w1 w1 w2")]  # items of one id tell rows apart by text only
    a, b = frames(spark, items, docs)
    a.write.parquet(str(tmp_path / "benchmark.parquet"))
    b.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, L.op12_fp_tree_search(spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(L.OP12_SQL).fetchall(), key=key)
