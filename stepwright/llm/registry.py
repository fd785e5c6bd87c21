"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import cotrain, decontaminate, lexical_search, minhash_forest, mix, substring, tiff, token_counts, token_store, toxicity, warc, wrapper, yinyang

QUERIES: dict[str, Callable] = {
    "op1_benchmark_prefix_join": decontaminate.query,
    "op2_token_planes": token_store.query,
    "op3_substring_anchors": substring.query,
    "op4_quality_cotraining": cotrain.query,
    "op5_minhash_forest": minhash_forest.query,
    "op6_mix_blocks": mix.query,
    "op7_toxicity_channel": toxicity.query,
    "op8_tiff_pages": tiff.query,
    "op9_wrapper_text": wrapper.query,
    "op10_warc_archive": warc.query,
    "op11_transducer_counts": token_counts.query,
    "op12_yinyang_clusters": yinyang.query,
    "op13_threshold_search": lexical_search.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_prefix_join": decontaminate.ORACLE_SQL,
    "op3_substring_anchors": substring.ORACLE_SQL,
    "op5_minhash_forest": minhash_forest.ORACLE_SQL,
    "op6_mix_blocks": mix.ORACLE_SQL,
    "op10_warc_archive": warc.ORACLE_SQL,
    "op12_yinyang_clusters": yinyang.ORACLE_SQL,
    "op13_threshold_search": lexical_search.ORACLE_SQL,
}
