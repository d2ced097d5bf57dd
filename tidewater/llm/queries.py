"""The queries of this subpackage, their SQL where there is one, by name."""

from __future__ import annotations

from tidewater.llm import bpe, chat, decontaminate, htmltext, langid, neardup, oracles, pii, shards, topk, toxicity

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_toxicity": toxicity.op2,
    "op3_html_extraction": htmltext.op3,
    "op4_sharding": shards.op4,
    "op5_chat_formatting": chat.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_pii": pii.op7,
    "op8_near_duplicates": neardup.op8,
    "op9_bpe": bpe.op9,
    "op10_topk_search": topk.op10,
}

#: The others need compression, models, tokenizers, hashes or match positions that SQL hasn't; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_sharding": oracles.OP4,
    "op5_chat_formatting": oracles.OP5,
    "op6_decontamination": oracles.OP6,
    "op10_topk_search": oracles.OP10,
}
