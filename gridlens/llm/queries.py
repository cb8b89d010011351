"""Queries of the training-data operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, decontaminate, embed_dedup, lexical, lm, packing, pii, quality, secrets, simhash, spelling, toxicity

QUERIES = {
    "op1_quality": quality.op1,
    "op2_packing": packing.op2,
    "op3_secrets": secrets.op3,
    "op4_toxicity": toxicity.op4,
    "op5_lm_scores": lm.op5,
    "op6_pii": pii.op6,
    "op7_neighbours": ann.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_simhash": simhash.op9,
    "op10_chat": chat.op10,
    "op11_lexical": lexical.op11,
    "op12_embed_dedup": embed_dedup.op12,
    "op13_spelling": spelling.op13,
}
ORACLE_SQL: dict[str, str] = {"op11_lexical": lexical.OP11_SQL, "op12_embed_dedup": embed_dedup.OP12_SQL}
