"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, exact_dedup, language_id, packing, quality_classifier, quality_rules, secrets, sharding, simhash, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_warc_roundtrip": warc.op5_warc_roundtrip,
    "op6_language_id": language_id.op6_language_id,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_shard_placement": sharding.op8_shard_placement,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
    "pipeline": corpus_pipeline.run,
}

#: SimHash needs XXH64, which DuckDB lacks; BPE, packing, the models and the table's filling aren't SQL.
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op5_warc_roundtrip": warc.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_secret_scan": secrets.ORACLE_SQL,
}
