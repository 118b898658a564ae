"""Queries of this subpackage, by name."""

from __future__ import annotations

from tessera.llm import decontaminate, langid, licenses, lines, lm, packing, pages, periods, phrases, quality, simhash, substrings, urls

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_packing": packing.op3_packing,
    "op4_main_text": pages.op4_main_text,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_quality": quality.op7_quality,
    "op8_licenses": licenses.op8_licenses,
    "op9_lm_score": lm.op9_lm_score,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_url_filter": urls.op11_url_filter,
    "op12_collocations": phrases.op12_collocations,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_substring_dedup": substrings.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op10_line_dedup": lines.ORACLE,
    "op11_url_filter": urls.ORACLE,
    "op12_collocations": phrases.ORACLE,
}
