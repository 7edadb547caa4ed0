"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from slotledger.llm.chat import OP8_SQL, op8_chat
from slotledger.llm.decontamination import OP2_SQL, op2_decontamination
from slotledger.llm.doc_fingerprints import op9_fingerprints
from slotledger.llm.filter_audit import OP12_SQL, op12_filter_audit
from slotledger.llm.language import op4_language
from slotledger.llm.mixing import op7_mixing
from slotledger.llm.near_dedup import op1_near_dedup
from slotledger.llm.quality import op10_quality
from slotledger.llm.spelling import op13_spelling
from slotledger.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from slotledger.llm.suffix_tree import op11_lm_score
from slotledger.llm.token_counts import op5_token_counts
from slotledger.llm.token_files import op6_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_decontamination,
        op3_substring_dedup,
        op4_language,
        op5_token_counts,
        op6_token_files,
        op7_mixing,
        op8_chat,
        op9_fingerprints,
        op10_quality,
        op11_lm_score,
        op12_filter_audit,
        op13_spelling,
    )
}

SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op8_chat": OP8_SQL,
    "op12_filter_audit": OP12_SQL,
}
