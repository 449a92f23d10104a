"""The row-wise inventory steps on a stream of survey files.

Imputation, carbon stock and growth are column expressions over one row, so the
batch operators take a streaming frame as it is; no state and no watermark are
needed. The reference workflow has no streaming of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sylvaq.operators.inventory import annual_growth, carbon_stocks, impute_diameters


def survey_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """New parquet files of a folder, at most ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def with_carbon(trees: DataFrame, models: DataFrame) -> DataFrame:
    """Imputed diameters, stocks and annual growth of a batch or streaming frame; ``models`` is static."""
    return annual_growth(carbon_stocks(impute_diameters(trees, models)))


def write_carbon(trees: DataFrame, models: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends every available file's result to ``out`` exactly once, then stops."""
    w = with_carbon(trees, models).writeStream.format("parquet").outputMode("append")
    return w.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
