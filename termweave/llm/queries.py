"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from termweave.llm.decontamination import op7_benchmark_decontamination
from termweave.llm.fingerprints import op8_document_fingerprints
from termweave.llm.fim import OP12_SQL, op12_fill_in_middle
from termweave.llm.lm import op6_lm_scoring
from termweave.llm.merkle import OP11_SQL, op11_merkle_manifest
from termweave.llm.neardup import op5_minhash_near_dedup
from termweave.llm.oracles import OP5_SQL, OP7_SQL
from termweave.llm.packing import op4_best_fit_packing
from termweave.llm.quality import op2_quality_classifier
from termweave.llm.repeats import op9_suffix_array_dedup
from termweave.llm.revisits import OP10_SQL, op10_warc_revisits
from termweave.llm.secrets import op3_secret_scan
from termweave.llm.token_counts import op1_token_counts
from termweave.llm.toxicity import op13_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scan": op3_secret_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_toxicity": op13_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": OP5_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op10_warc_revisits": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
