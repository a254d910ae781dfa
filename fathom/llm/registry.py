"""The operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from fathom.llm.bpe import op13_bpe_tokens
from fathom.llm.decontaminate import OP3_SQL, op3_winnow_decontamination
from fathom.llm.lexical_search import OP11_SQL, op11_ranked_search
from fathom.llm.license_scan import op8_license_scan
from fathom.llm.line_dedup import OP7_SQL, op7_line_dedup
from fathom.llm.lm_score import op5_bloom_lm_score
from fathom.llm.mixing import op9_mix_schedule
from fathom.llm.quality import op6_quality_rules, quality_sql
from fathom.llm.sharding import op2_stratified_shards
from fathom.llm.simhash import op4_simhash_components
from fathom.llm.substring_dedup import op1_run_length_dedup
from fathom.llm.url_filter import OP10_SQL, op10_url_rules
from fathom.llm.whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_run_length_dedup, op2_stratified_shards, op3_winnow_decontamination, op4_simhash_components, op5_bloom_lm_score, op6_quality_rules, op7_line_dedup, op8_license_scan, op9_mix_schedule, op10_url_rules, op11_ranked_search, op12_embedding_whitening, op13_bpe_tokens)}
SQL = {"op3_winnow_decontamination": OP3_SQL, "op6_quality_rules": quality_sql(), "op7_line_dedup": OP7_SQL, "op10_url_rules": OP10_SQL, "op11_ranked_search": OP11_SQL}
