"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontam, mixing, preference, quality, repeats, secrets, sharding, simhash, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op2_preference_format": preference.query,
    "op3_mixing": mixing.query,
    "op4_token_files": tokens.query,
    "op5_secret_scan": secrets.query,
    "op6_decontamination": decontam.query,
    "op7_repeated_strings": repeats.query,
    "op8_simhash": simhash.query,
    "op9_classifier": classifier.query,
    "op10_sharding": sharding.query,
}

ORACLES: dict[str, str] = {"op1_quality_rules": quality.SQL, "op2_preference_format": preference.SQL, "op6_decontamination": decontam.SQL, "op7_repeated_strings": repeats.SQL}
