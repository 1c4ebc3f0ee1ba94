"""The registered queries of the subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from millrace.llm import decontaminate, fingerprints, hard_negatives, html_extract, line_dedup, orc_tokens, packing, pii, quality_model, quality_rules, simhash, spelling, substring_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_nbsvm": quality_model.op2_nbsvm,
    "op3_orc_tokens": orc_tokens.op3_orc_tokens,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_rules": quality_rules.op5_line_rules,
    "op6_suffix_dedup": substring_dedup.op6_suffix_dedup,
    "op7_main_text": html_extract.op7_main_text,
    "op8_simhash": simhash.op8_simhash,
    "op9_pack": packing.op9_pack,
    "op10_site_lines": line_dedup.op10_site_lines,
    "op11_spelling": spelling.op11_spelling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}
ORACLE_SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_line_rules": quality_rules.OP5_SQL,
    "op10_site_lines": line_dedup.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
