"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from meritgraph.llm.align import op12_tokenizer_alignment
from meritgraph.llm.audit import OP13_SQL, op13_filter_audit
from meritgraph.llm.boilerplate import op7_html_extraction
from meritgraph.llm.bpe import op1_byte_bpe
from meritgraph.llm.fingerprints import op3_fingerprints
from meritgraph.llm.language import op10_language_id
from meritgraph.llm.neardup import op2_minhash_neardup
from meritgraph.llm.lines import OP6_SQL, op6_line_dedup
from meritgraph.llm.ngrams import op9_lm_scoring
from meritgraph.llm.packing import op8_packing
from meritgraph.llm.quality import OP4_SQL, op4_quality_rules
from meritgraph.llm.simhash import op11_simhash_neardup
from meritgraph.llm.urls import OP5_SQL, op5_url_filters

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_minhash_neardup, op3_fingerprints, op4_quality_rules, op5_url_filters, op6_line_dedup, op7_html_extraction, op8_packing, op9_lm_scoring, op10_language_id, op11_simhash_neardup, op12_tokenizer_alignment, op13_filter_audit)}
SQL = {"op4_quality_rules": OP4_SQL, "op5_url_filters": OP5_SQL, "op6_line_dedup": OP6_SQL, "op13_filter_audit": OP13_SQL}
