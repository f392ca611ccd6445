"""Registered queries of the training-data operators."""

from __future__ import annotations

import importlib

from .decontaminate import OP1_SQL
from .importance import OP13_SQL
from .spelling import OP12_SQL
from .url_filter import OP3_SQL
from .warc import OP9_SQL

#: query -> (module, function)
_WHERE = {
    "op1_decontaminate": ("decontaminate", "op1_decontaminate"),
    "op2_language_id": ("language_id", "op2_language_id"),
    "op3_url_filter": ("url_filter", "op3_url_filter"),
    "op4_packing": ("packing", "op4_packing"),
    "op5_near_dedup": ("near_dedup", "op5_near_dedup"),
    "op6_substring_dedup": ("substring_dedup", "op6_substring_dedup"),
    "op7_quality": ("quality", "op7_quality"),
    "op8_fingerprints": ("fingerprint", "op8_fingerprints"),
    "op9_warc": ("warc", "op9_warc"),
    "op10_lm_score": ("lm_score", "op10_lm_score"),
    "op11_toxicity": ("toxicity", "op11_toxicity"),
    "op12_spelling_variants": ("spelling", "op12_spelling_variants"),
    "op13_importance_resampling": ("importance", "op13_importance_resampling"),
}


def _query(module: str, function: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), function)(spark, sf_dir)


QUERIES = {name: _query(*where) for name, where in _WHERE.items()}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_url_filter": OP3_SQL, "op9_warc": OP9_SQL}
ORACLE_SQL |= {"op12_spelling_variants": OP12_SQL, "op13_importance_resampling": OP13_SQL}


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
