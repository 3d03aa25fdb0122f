"""Registered queries on the smallest driver table: contract columns, SQL, and the pipeline against brute force."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from fluvio.llm import decontaminate, quality
from fluvio.llm.common import table, write_table
from fluvio.llm.queries import ORACLES, QUERIES

from .test_texts import components_by_hand, targets_by_hand

COLUMNS = {
    "op1": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5": ["doc_id", "n_shingles", "component_id"],
    "op6": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_the_smallest_table(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    op = name.split("_")[0]
    assert df.columns[:len(COLUMNS.get(op, []))] == COLUMNS.get(op, [])
    rows = [tuple(r) for r in df.collect()]
    if op in COLUMNS:
        assert len(rows) == table(spark, sf_small, "documents").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "conversations", "benchmark", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
        res = con.execute(ORACLES[name])
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(rows, key=repr) == sorted((tuple(dict(zip(cols, r))[c] for c in df.columns) for r in res.fetchall()), key=repr)


def test_pipeline_stages_against_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    rows = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, sf_small), "test-pipeline")
        rows[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    # quality: just the documents whose score reaches the threshold
    scores = quality.quality_scores(table(spark, sf_small, "documents"), table(spark, sf_small, "labels"))
    assert {r.doc_id for r in rows["quality"]} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    # near duplicates: the least id of each group of what was left
    groups = components_by_hand([(r.doc_id, r.text) for r in rows["quality"]])
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted({c for _, _, c in groups})
    # decontamination: documents without 13 aligned words of an item, two of which may differ
    items = [decontaminate_words(r.text) for r in table(spark, sf_small, "benchmark").collect()]
    clean = [r.doc_id for r in rows["near_duplicates"] if not any(aligned(decontaminate_words(r.text), i) for i in items)]
    assert sorted(r.doc_id for r in rows["decontamination"]) == sorted(clean)
    # mixing: whole copies, near the targets
    size, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in rows["mixing"])
    largest = defaultdict(int)
    for r in rows["decontamination"]:
        n = len(r.text.encode().split())
        size[r.source] += n
        taken[r.source] += n * times[r.doc_id]
        largest[r.source] = max(largest[r.source], n)
    assert max(times.values()) <= 3
    for s, t in targets_by_hand(size).items():
        assert abs(taken[s] - t) <= max(0.1 * t, largest[s])
    # sharding: every row once, even shards
    at = defaultdict(list)
    for r in rows["sharding"]:
        at[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in rows["sharding"]) == times
    lengths = [len(at[s]) for s in range(40)]
    assert max(lengths) - min(lengths) <= 1 and all(sorted(v) == list(range(len(v))) for v in at.values())


def decontaminate_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def aligned(doc, item, window=decontaminate.WINDOW, may_differ=decontaminate.SUBSTITUTIONS):
    at = defaultdict(list)
    for i, w in enumerate(item):
        at[w].append(i)
    hits = Counter(p - i for p, w in enumerate(doc) for i in at.get(w, ()))
    for offset, n in hits.items():
        if n < min(window, len(item)) - may_differ:
            continue
        same = [doc[offset + i] == item[i] for i in range(max(0, -offset), min(len(item), len(doc) - offset))]
        w = min(window, len(item))
        if any(sum(same[k:k + w]) >= w - (may_differ if w == window else w * may_differ // window) for k in range(len(same) - w + 1)):
            return True
    return False
