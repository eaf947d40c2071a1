"""Queries of the training-data operators, by name."""

from __future__ import annotations

from importlib import import_module

#: query name: module of this package that has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
OPERATORS = {
    "op1_ngram_jaccard_join": "ngram_join",
    "op2_kneser_ney_quality": "kneser_ney",
    "op3_mixing_weights": "mixing",
    "op4_hilbert_neighbours": "hilbert_ann",
    "op5_suffix_array_dedup": "suffix_dedup",
    "op6_toxicity": "toxicity",
    "op7_license_scan": "licences",
    "op8_benchmark_decontamination": "decontaminate",
    "op9_token_packing": "packing",
    "op10_sharding": "sharding",
    "op11_bpe": "bpe",
    "op12_source_audit": "source_audit",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: import_module(f"strandline.llm.{module}").query for name, module in OPERATORS.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {name: getattr(import_module(f"strandline.llm.{module}"), "ORACLE_SQL", None) for name, module in OPERATORS.items()}
    found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
