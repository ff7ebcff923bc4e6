"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, collocations, embed_dedup, language, mixing, near_dedup, packing, periodic_runs, pii, secret_scan, substring_dedup, url_filter, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_nearest": ann.op6_nearest,
    "op7_pii": pii.op7_pii,
    "op8_embedding_dedup": embed_dedup.op8_embedding_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_collocations": collocations.op12_collocations,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op2_url_filter": url_filter.oracle(),
    "op4_warc": warc.ORACLE,
    "op6_nearest": ann.ORACLE,
    "op8_embedding_dedup": embed_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_secret_scan": secret_scan.oracle(),
    "op12_collocations": collocations.oracle(),
}
