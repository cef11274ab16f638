"""The corpus operators' queries and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from . import ann, bpe, decontam, html_extract, lang_id, line_dedup, secret_scan, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_decontamination": decontam.query,
    "op2_byte_bpe": bpe.query,
    "op3_secret_scan": secret_scan.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_simhash": simhash.query,
    "op7_nearest_neighbours": ann.query,
    "op8_html_extraction": html_extract.query,
    "op9_language_id": lang_id.query,
    "op10_url_filter": url_filter.query,
}

ORACLES = {
    "op1_decontamination": decontam.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
