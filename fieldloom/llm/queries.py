"""Queries of the training-data operators, and their DuckDB twins where SQL expresses them."""

from __future__ import annotations

from fieldloom.llm import alignment, chat, classifier, embedding_dedup, line_dedup, mixing, packing, pieces, quality_rules, secrets, simhash, substring_dedup, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_chat": chat.op2,
    "op3_packing": packing.op3,
    "op4_embedding_dedup": embedding_dedup.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_classifier": classifier.op6,
    "op7_simhash": simhash.op7,
    "op8_mixing": mixing.op8,
    "op9_line_dedup": line_dedup.op9,
    "op9_passage_dedup": line_dedup.op9_passages,
    "op10_secrets": secrets.op10,
    "op11_pieces": pieces.op11,
    "op12_whitening": whitening.op12,
    "op13_alignment": alignment.op13,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op9_passage_dedup": line_dedup.OP9_PASSAGES_SQL,
    "op10_secrets": secrets.OP10_SQL,
}
