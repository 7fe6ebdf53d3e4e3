"""The corpus operators' queries, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op7_forced_boundary_bpe
from .htmltext import op8_html_extraction
from .licenses import op6_license_scan
from .packing import op1_harmonic_packing
from .quality import op4_quality_rules
from .simhash import op2_simhash_near_dedup
from .substrings import op10_substring_dedup
from .syncmers import op5_closed_syncmers
from .tokencounts import op3_prefix_token_counts
from .toxicity import op9_toxicity_mil

QUERIES = {f.__name__: f for f in (op1_harmonic_packing, op2_simhash_near_dedup, op3_prefix_token_counts, op4_quality_rules, op5_closed_syncmers, op6_license_scan, op7_forced_boundary_bpe, op8_html_extraction, op9_toxicity_mil, op10_substring_dedup)}
ORACLES: dict[str, str] = {}
