"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import mapping, names, neardup, packing, personal, residue, scans, splitting, tokenize


def queries() -> dict:
    return {
        "p1_found": mapping.p1_found,
        "p1_unmatched": mapping.p1_unmatched,
        "p2_found": splitting.p2_found,
        "p2_pieces": splitting.p2_pieces,
        "p2_rejoined": splitting.p2_rejoined,
        "p3_found": neardup.p3_found,
        "p3_groups": neardup.p3_groups,
        "p4_found": personal.p4_found,
        "p4_masked": personal.p4_masked,
        "p5_found": names.p5_found,
        "p5_entities": names.p5_entities,
        "p6_found": scans.p6_found,
        "p6_repaired": scans.p6_repaired,
        "p6_forms": scans.p6_forms,
        "p7_ids": tokenize.p7_ids,
        "p7_token_stats": tokenize.p7_token_stats,
        "p8_packed": packing.p8_packed,
        "p8_fill": packing.p8_fill,
        "p9_found": residue.p9_found,
        "p9_kept": residue.p9_kept,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT p.provider, d.doc_id FROM prompt_configs p JOIN documents d ON strlen(d.text) > p.max_text_length
        """,
        "p2_rejoined": """
            SELECT p.provider, d.doc_id, sha256(d.text) AS sha256, true AS fits FROM prompt_configs p, documents d WHERE d.text <> ''
        """,
    }
