"""The queries of this subpackage, and the SQL that checks them, by name."""

from lodestone.llm import cotrain, crf, decontam, divergence, kneser_ney, licenses, mixing, naming, quality, repair, simhash, urls, warc

QUERIES = {
    "op1_language_id": crf.query,
    "op2_quality_cotraining": cotrain.query,
    "op3_warc_boundary_chain": warc.query,
    "op4_license_scan": licenses.query,
    "op5_kneser_ney_scoring": kneser_ney.query,
    "op6_benchmark_decontamination": decontam.query,
    "op7_quality_rules": quality.query,
    "op8_url_filter": urls.query,
    "op9_source_mixing": mixing.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_conversation_repair": repair.query,
    "op12_block_naming_dedup": naming.query,
    "op13_source_divergence": divergence.query,
}
#: Operators without an entry here have no SQL form; tests hold them against plain Python or held-out rows.
ORACLES = {
    "op3_warc_boundary_chain": warc.ORACLE_SQL,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op6_benchmark_decontamination": decontam.ORACLE_SQL,
    "op8_url_filter": urls.ORACLE_SQL,
    "op11_conversation_repair": repair.ORACLE_SQL,
    "op12_block_naming_dedup": naming.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
