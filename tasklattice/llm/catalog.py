"""The operators' queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from tasklattice.llm.chat_format import OP13_SQL, op13_chat_format
from tasklattice.llm.decontaminate import op1_decontaminate
from tasklattice.llm.embedding_join import OP3_SQL, op3_embedding_join
from tasklattice.llm.html_text import op10_html_text
from tasklattice.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from tasklattice.llm.language_id import op7_language_id
from tasklattice.llm.lexical_search import OP11_SQL, op11_lexical_search
from tasklattice.llm.line_dedup import OP8_SQL, op8_line_dedup
from tasklattice.llm.maxent_lm import op4_maxent_lm
from tasklattice.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from tasklattice.llm.packing import op6_packing
from tasklattice.llm.secret_scan import op9_secret_scan
from tasklattice.llm.token_counts import op2_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_token_counts,
        op3_embedding_join,
        op4_maxent_lm,
        op5_jaccard_join,
        op6_packing,
        op7_language_id,
        op8_line_dedup,
        op9_secret_scan,
        op10_html_text,
        op11_lexical_search,
        op12_merkle_manifest,
        op13_chat_format,
    )
}

SQL = {
    "op3_embedding_join": OP3_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
