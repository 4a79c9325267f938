"""This package's queries for the driver, and their SQL."""

from __future__ import annotations

from . import decontam, html, licenses, lines, packing, pii, pst, quality, sharding, simhash

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_lm_scoring": pst.op9_lm_scoring,
    "op10_html": html.op10_html,
}

ORACLE_SQL = {"op7_quality_rules": quality.OP7_SQL}
