"""Tables, JSON arguments and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_list(c: Column, element: str, key: str) -> Column:
    """An array given as ``[...]`` or as ``{"<key>": [...]}``; null if it is neither."""
    plain = F.from_json(c, f"array<{element}>")
    held = F.from_json(c, f"struct<{key}:array<{element}>>")[key]
    return F.when(F.ltrim(c).startswith("["), plain).otherwise(held)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


@dataclass(frozen=True)
class Settings:
    """Limits with their defaults; an environment variable of the same name, upper case, that isn't empty replaces one."""

    max_input_chars: int = 120_000
    chunk_size: int = 6_000
    chunk_overlap: int = 400
    max_model_checks: int = 20
    top_k: int = 8
    similarity_threshold: float = 0.2

    @classmethod
    def from_env(cls, prefix: str = "PROCURELAKE_") -> Settings:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper(), "").strip()
            if raw:
                found[f.name] = type(f.default)(raw)
        return cls(**found)
