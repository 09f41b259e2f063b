"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from threadloom.llm.chat_format import OP8_SQL, op8_chat_format
from threadloom.llm.decontamination import op2_decontamination
from threadloom.llm.language_id import op5_language_id
from threadloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from threadloom.llm.minhash import op3_minhash
from threadloom.llm.posting_lists import op10_posting_lists
from threadloom.llm.pseudonyms import op4_pseudonyms
from threadloom.llm.rare_digest import op12_rare_digest
from threadloom.llm.sentencepiece_bpe import op6_sentencepiece
from threadloom.llm.source_audit import OP11_SQL, op11_source_audit
from threadloom.llm.spelling import op13_spelling_variants
from threadloom.llm.token_output import op1_token_output
from threadloom.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_minhash": op3_minhash,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_language_id": op5_language_id,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc": op7_warc,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_posting_lists": op10_posting_lists,
    "op11_source_audit": op11_source_audit,
    "op12_rare_digest": op12_rare_digest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_source_audit": OP11_SQL,
}
