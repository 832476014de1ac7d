"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dendrolith.llm.backoff import OP7_SQL, op7_stupid_backoff
from dendrolith.llm.bpe import op9_bpe_round_trip
from dendrolith.llm.hamming_search import OP4_SQL, op4_multi_index_search
from dendrolith.llm.html import op10_html_main_text
from dendrolith.llm.infill import OP11_SQL, op11_fill_in_middle
from dendrolith.llm.jaccard_join import OP13_SQL, op13_jaccard_join
from dendrolith.llm.mixing import op5_flow_mixture
from dendrolith.llm.perplexity import op3_kneser_ney_bands
from dendrolith.llm.point_in_time import OP12_SQL, op12_point_in_time
from dendrolith.llm.quality import op8_crf_quality
from dendrolith.llm.repeats import op6_radix_repeats
from dendrolith.llm.sharding import op1_feistel_shards
from dendrolith.llm.simhash import op2_simhash_near_duplicates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_feistel_shards": op1_feistel_shards,
        "op2_simhash_near_duplicates": op2_simhash_near_duplicates,
        "op3_kneser_ney_bands": op3_kneser_ney_bands,
        "op4_multi_index_search": op4_multi_index_search,
        "op5_flow_mixture": op5_flow_mixture,
        "op6_radix_repeats": op6_radix_repeats,
        "op7_stupid_backoff": op7_stupid_backoff,
        "op8_crf_quality": op8_crf_quality,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_html_main_text": op10_html_main_text,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_point_in_time": op12_point_in_time,
        "op13_jaccard_join": op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_multi_index_search": OP4_SQL, "op7_stupid_backoff": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_point_in_time": OP12_SQL, "op13_jaccard_join": OP13_SQL}
