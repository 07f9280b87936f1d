"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from tessera.llm import decontamination, html_text, licenses, negatives, packing, periodic, pii, prefix_join, quality, sharding, simhash, substrings, url_filter


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1,
        "op2_substrings": substrings.op2,
        "op3_packing": packing.op3,
        "op4_quality": quality.op4,
        "op5_pii": pii.op5,
        "op6_html": html_text.op6,
        "op7_url_filter": url_filter.op7,
        "op8_sharding": sharding.op8,
        "op9_decontamination": decontamination.op9,
        "op10_licenses": licenses.op10,
        "op11_periodic": periodic.op11,
        "op12_ngram_join": prefix_join.op12,
        "op13_negatives": negatives.op13,
    }


def oracle_sql() -> dict:
    return {
        "op2_substrings": substrings.OP2_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op9_decontamination": decontamination.OP9_SQL,
        "op11_periodic": periodic.OP11_SQL,
        "op12_ngram_join": prefix_join.OP12_SQL,
        "op13_negatives": negatives.OP13_SQL,
    }
