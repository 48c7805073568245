"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lectern.llm import (
    conversation_repair, decontaminate, epsilon_grid, html_extract, jaccard_join, langid, licenses, packing, periodic_runs, secrets, sharding, token_counts, url_filters,
)

QUERIES = {
    "op1_token_counts": token_counts.registered,
    "op2_decontamination": decontaminate.registered,
    "op3_license_scan": licenses.registered,
    "op4_jaccard_join": jaccard_join.registered,
    "op5_packing": packing.registered,
    "op6_url_filter": url_filters.registered,
    "op7_secret_scan": secrets.registered,
    "op8_language_id": langid.registered,
    "op9_embedding_near_dedup": epsilon_grid.registered,
    "op10_html_extraction": html_extract.registered,
    "op11_feistel_sharding": sharding.registered,
    "op12_conversation_repair": conversation_repair.registered,
    "op13_periodic_runs": periodic_runs.registered,
}
ORACLES = {"op2_decontamination": decontaminate.ORACLE, "op11_feistel_sharding": sharding.ORACLE}
