"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from eventlens.llm.centroids import OP11_SQL, op11_clusters
from eventlens.llm.chat import OP1_SQL, op1_chat_format
from eventlens.llm.decontam import op7_decontamination
from eventlens.llm.hilbert import op4_hilbert_shards
from eventlens.llm.license_scan import OP13_SQL, op13_license_scan
from eventlens.llm.line_dedup import op8_line_dedup
from eventlens.llm.pieces import op6_pieces
from eventlens.llm.quality_rules import OP5_SQL, op5_quality_rules
from eventlens.llm.resampling import OP12_SQL, op12_resampling
from eventlens.llm.simhash import op10_simhash
from eventlens.llm.token_counts import op9_token_counts
from eventlens.llm.token_files import op2_token_files
from eventlens.llm.toxicity import op3_toxicity

LLM_QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_quality_rules": op5_quality_rules,
    "op6_pieces": op6_pieces,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_clusters": op11_clusters,
    "op12_resampling": op12_resampling,
    "op13_license_scan": op13_license_scan,
}

LLM_ORACLE = {
    "op1_chat_format": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op11_clusters": OP11_SQL,
    "op12_resampling": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
