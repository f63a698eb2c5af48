"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from episodica.llm import chat, decontaminate, html, licenses, mixing, pii, quality, repair, resampling, simhash, suffix_dedup, token_ids, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_html_main_text": html.op2_html_main_text,
    "op3_chat_format": chat.op3_chat_format,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_token_ids": token_ids.op10_token_ids,
    "op11_personal_data": pii.op11_personal_data,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_conversation_repair": repair.op13_conversation_repair,
    "quality_ablation": quality.quality_ablation,
    "quality_policies": quality.quality_policies,
    "warc_read_by_predicate": warc.warc_read_by_predicate,
}
ORACLE_SQL = {
    "op3_chat_format": chat.OP3_SQL,
    "op4_source_mix": mixing.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_warc_round_trip": warc.OP8_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op11_personal_data": pii.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "quality_policies": quality.POLICIES_SQL,
    "warc_read_by_predicate": warc.PREDICATE_SQL,
}
