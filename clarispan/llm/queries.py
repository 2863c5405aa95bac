"""Queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from clarispan.llm import collocations, conversation_repair, exact_topk
from clarispan.llm.bpe import op4_bpe
from clarispan.llm.collocations import op12_collocations
from clarispan.llm.conversation_repair import op13_conversation_repair
from clarispan.llm.exact_topk import op1_exact_topk
from clarispan.llm.html_extraction import op11_html_extraction
from clarispan.llm.kd_sharding import op9_kd_sharding
from clarispan.llm.language_id import op7_language_id
from clarispan.llm.line_dedup import op3_line_dedup
from clarispan.llm.lz_fingerprint import op5_lz_fingerprint
from clarispan.llm.packing import op8_packing
from clarispan.llm.quality import op6_quality
from clarispan.llm.simhash_neardup import op2_simhash_neardup
from clarispan.llm.token_counts import op10_token_counts

QUERIES = {f.__name__: f for f in (
    op1_exact_topk, op2_simhash_neardup, op3_line_dedup, op4_bpe, op5_lz_fingerprint, op6_quality, op7_language_id,
    op8_packing, op9_kd_sharding, op10_token_counts, op11_html_extraction, op12_collocations, op13_conversation_repair,
)}

SQL: dict[str, str] = {"op1_exact_topk": exact_topk.SQL, "op12_collocations": collocations.SQL, "op13_conversation_repair": conversation_repair.SQL}
