"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontamination, html_extract, line_dedup, pii, quality_rules, secrets_scan, simhash, spelling, structure_repair, suffix_dedup, url_filters

QUERIES = {
    "op1_secret_scan": secrets_scan.op1_secret_scan,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_pii": pii.op5_pii,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_structure_repair": structure_repair.op12_structure_repair,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op4_url_filters": url_filters.OP4_SQL,
    "op5_pii": pii.OP5_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
}
