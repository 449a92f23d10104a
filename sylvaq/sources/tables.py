"""Test tables and connectors: parquet folders, CSV with missing-value conventions, missing-file guard."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; columns and filters are pruned into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; text that does not fit a number becomes NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """read_csv, or None with a message where the path does not exist."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"no such input: {path}")
        return None


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header; NULL and empty text both come out as nothing between commas."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN of floating-point columns as NULL; the scan boundary of frames that mark missing values by NaN."""
    floats = [f.name for f in df.schema if f.dataType in (T.DoubleType(), T.FloatType())]
    todo = [c for c in floats if columns is None or c in columns]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in todo})


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds typed NULL columns for those of ``columns`` (name -> type) that are absent."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def copied_if_absent(df: DataFrame, copies: dict[str, str]) -> DataFrame:
    """Adds each column of ``copies`` that is absent as a copy of the one named there; present ones stay as they are."""
    return df.withColumns({c: F.col(f"`{source}`") for c, source in copies.items() if c not in df.columns})


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or a clear error naming the absent columns."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def keep_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
