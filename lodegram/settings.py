"""Settings under ``lodegram.`` in the session's configuration; checked when they are used."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import SparkSession

PREFIX = "lodegram."
DEFAULTS = {"auto_accelerate": "false", "max_candidate_fraction": "0.01", "max_grams_per_query": "3", "max_probe_rowids": "100000000", "max_probe_memory": str(256 << 20), "build_partitions": "0"}


@dataclass(frozen=True)
class Settings:
    auto_accelerate: bool
    max_candidate_fraction: float
    max_grams_per_query: int
    max_probe_rowids: int
    max_probe_memory: int
    build_partitions: int


def settings(spark: SparkSession) -> Settings:
    raw = {k: spark.conf.get(PREFIX + k, v) for k, v in DEFAULTS.items()}
    fraction = float(raw["max_candidate_fraction"])
    if math.isnan(fraction) or fraction < 0:
        raise ValueError("max_candidate_fraction must not be negative or NaN")
    grams, rows, memory, parts = (int(raw[k]) for k in ("max_grams_per_query", "max_probe_rowids", "max_probe_memory", "build_partitions"))
    if grams < 1:
        raise ValueError("max_grams_per_query must be at least 1")
    if rows < 1:
        raise ValueError("max_probe_rowids must be at least 1")
    if memory < 1:
        raise ValueError("max_probe_memory must be at least 1")
    if parts < 0:
        raise ValueError("build_partitions must not be negative")
    return Settings(raw["auto_accelerate"].lower() == "true", fraction, grams, rows, memory, parts)
