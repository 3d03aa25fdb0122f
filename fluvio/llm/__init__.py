"""Training-data operators: scoring, deduplication, mixing, sharding, formatting.

Each module holds one operator and the thin ``opN_<name>`` query over the
driver's tables; ``queries.py`` collects them. Nothing outside this
subpackage imports it.
"""
