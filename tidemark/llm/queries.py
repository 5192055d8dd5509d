"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .additive import OP7_SQL, op7_additive_quantisation
from .chat import op5_tool_call_linking
from .graph import OP4_SQL, op4_graph_near_dedup
from .html import op3_html_extraction
from .langid import op10_language_id
from .mixing import OP9_SQL, op9_mixing
from .secrets import OP2_SQL, op2_secret_scan
from .sentencepieces import op8_sentencepiece
from .simhash import op6_simhash_near_dedup
from .urlfilter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_extraction": op3_html_extraction,
    "op4_graph_near_dedup": op4_graph_near_dedup,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_additive_quantisation": op7_additive_quantisation,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_secret_scan": OP2_SQL,
    "op4_graph_near_dedup": OP4_SQL,
    "op7_additive_quantisation": OP7_SQL,
    "op9_mixing": OP9_SQL,
}
