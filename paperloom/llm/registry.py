"""The queries of this subpackage and the SQL that expresses some of them."""

from __future__ import annotations

from paperloom.llm import bpe, chat, decontaminate, exact_dedup, language_id, line_dedup, mtree, pii, prefix_trie, resample, secrets, setsketch, sharding

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_secrets": secrets.op2_secrets,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_exact_topk": mtree.op5_exact_topk,
    "op6_pii": pii.op6_pii,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_bpe": bpe.op8_bpe,
    "op9_sharding": sharding.op9_sharding,
    "op10_near_dedup": setsketch.op10_near_dedup,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_resample": resample.op13_resample,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_exact_topk": mtree.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_resample": resample.OP13_SQL,
}
