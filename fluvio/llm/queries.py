"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluvio.llm.chat import OP10_SQL, op10_preference_pairs
from fluvio.llm.decontaminate import op7_spaced_seeds
from fluvio.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from fluvio.llm.jaccard import op5_jaccard_prefix_tree
from fluvio.llm.katz import op1_katz_score
from fluvio.llm.lexical import OP12_SQL, op12_fp_tree_search
from fluvio.llm.mixing import op3_entropy_mix
from fluvio.llm.quality import op8_quality_trees
from fluvio.llm.repair import OP11_SQL, op11_structure_repair
from fluvio.llm.sharding import op4_hash_ring_shards
from fluvio.llm.token_count import op6_token_counts
from fluvio.llm.toxicity import op9_deobfuscated_toxicity
from fluvio.llm.url_filter import OP13_SQL, op13_url_ratio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_katz_score, op2_exact_dedup, op3_entropy_mix, op4_hash_ring_shards, op5_jaccard_prefix_tree, op6_token_counts,
        op7_spaced_seeds, op8_quality_trees, op9_deobfuscated_toxicity, op10_preference_pairs, op11_structure_repair,
        op12_fp_tree_search, op13_url_ratio,
    )
}
ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op10_preference_pairs": OP10_SQL, "op11_structure_repair": OP11_SQL, "op12_fp_tree_search": OP12_SQL, "op13_url_ratio": OP13_SQL}
