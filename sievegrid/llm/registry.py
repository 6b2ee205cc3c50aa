"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievegrid.llm.fill_in_middle import ORACLE_OP11, op11_fill_in_middle
from sievegrid.llm.hmm import op7_hmm_lm
from sievegrid.llm.minhash_join import ORACLE_OP3, op3_minhash_join
from sievegrid.llm.mixing import op6_source_mixture
from sievegrid.llm.packing import op10_best_fit_packing
from sievegrid.llm.quality_knn import op1_quality_knn
from sievegrid.llm.quality_rules import op13_quality_rules
from sievegrid.llm.sharding import op8_balanced_shards
from sievegrid.llm.simhash import op2_simhash
from sievegrid.llm.token_alignment import op12_token_alignment
from sievegrid.llm.token_files import op9_token_files
from sievegrid.llm.toxicity import op4_toxicity_counterfactual
from sievegrid.llm.vafile import ORACLE_OP5, op5_va_file_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_knn": op1_quality_knn,
        "op2_simhash": op2_simhash,
        "op3_minhash_join": op3_minhash_join,
        "op4_toxicity_counterfactual": op4_toxicity_counterfactual,
        "op5_va_file_topk": op5_va_file_topk,
        "op6_source_mixture": op6_source_mixture,
        "op7_hmm_lm": op7_hmm_lm,
        "op8_balanced_shards": op8_balanced_shards,
        "op9_token_files": op9_token_files,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_alignment": op12_token_alignment,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_join": ORACLE_OP3, "op5_va_file_topk": ORACLE_OP5, "op11_fill_in_middle": ORACLE_OP11}
