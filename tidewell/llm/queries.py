"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from tidewell.llm import chat_format, classifier, decontamination, line_dedup, metric_search, mixing, ngram_join, oracle, packing, periodic_runs, quality_rules, sharding, substring_dedup, whitening

OPERATORS = [
    sharding.op1_ring_sharding,
    metric_search.op2_mtree_search,
    quality_rules.op3_host_quality,
    line_dedup.op4_line_dedup,
    chat_format.op5_chat_format,
    packing.op6_bin_slack_packing,
    ngram_join.op7_ngram_trie_join,
    substring_dedup.op8_suffix_tree_dedup,
    classifier.op9_factor_machine,
    mixing.op10_mix_sources,
    whitening.op11_chebyshev_whitening,
    periodic_runs.op12_periodic_runs,
    decontamination.op13_suffix_array_decontamination,
]


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
