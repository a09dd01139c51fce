"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from sievework.llm.fingerprints import op5_fingerprints
from sievework.llm.language import op9_language
from sievework.llm.license_scan import op3_license_scan
from sievework.llm import lattice, line_dedup, matroska, mixture
from sievework.llm.quality import op6_quality
from sievework.llm.simhash_dedup import op10_simhash_near_dedup
from sievework.llm.token_output import op7_token_output

QUERIES = {
    "op1_media_columns": matroska.op1_media_columns,
    "op2_mixture": mixture.op2_mixture,
    "op3_license_scan": op3_license_scan,
    "op4_lattice_samples": lattice.op4_lattice_samples,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language": op9_language,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixture": mixture.SQL,
    "op8_line_dedup": line_dedup.SQL,
}
