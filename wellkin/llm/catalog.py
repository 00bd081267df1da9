"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wellkin.llm import (
    alignment,
    chat,
    decontaminate,
    extract,
    importance,
    language,
    licenses,
    packing,
    quality,
    repeats,
    simhash,
    suffixtree,
    toxicity,
)

ROOT = str(Path(__file__).resolve().parents[2])

_QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_licenses": licenses.op2_licenses,
    "op3_suffix_tree": suffixtree.op3_suffix_tree,
    "op4_language": language.op4_language,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_extract": extract.op8_extract,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_chat_prefixes": chat.op11_chat_prefixes,
    "op12_importance": importance.op12_importance,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": corpus_pipeline.run,
}


def _for_workers(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Lets Python workers started by the session import this package from where it lies."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if ROOT not in paths.split(os.pathsep):
            joined = os.pathsep.join(filter(None, (ROOT, paths)))
            spark.sparkContext.environment["PYTHONPATH"] = joined
        return query(spark, sf_dir)

    return run


QUERIES = {name: _for_workers(query) for name, query in _QUERIES.items()}
ORACLE = {**licenses.ORACLE, **decontaminate.ORACLE, **chat.ORACLE, **importance.ORACLE}
