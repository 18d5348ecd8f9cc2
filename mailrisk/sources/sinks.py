"""Writing splits, result tables, and the band table other readers join to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT, ScoringConfig


def write_splits(corpus: DataFrame, path: str, file_format: str = "parquet") -> None:
    """One folder per split; CSV keeps line breaks inside quotes."""
    writer = corpus.write.mode("errorifexists").partitionBy("split")
    if file_format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(file_format).save(path)


def write_report(table: DataFrame, path: str) -> None:
    """A small result (a curve, a sweep: at most 101 rows) as one CSV file."""
    table.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Error rows grow with the data: as many files as there are partitions."""
    errors.write.mode("errorifexists").option("header", True).csv(path)


def band_table(spark: SparkSession, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """The four bands with their lower edges and the threshold they come from."""
    low, medium, high = cfg.bands
    rows = [
        (cfg.threshold, high, lx.LEVEL_HIGH, lx.ADVICE_HIGH),
        (cfg.threshold, medium, lx.LEVEL_MEDIUM, lx.ADVICE_MEDIUM),
        (cfg.threshold, low, lx.LEVEL_LOW, lx.ADVICE_LOW),
        (cfg.threshold, 0, lx.LEVEL_SAFE, lx.ADVICE_SAFE),
    ]
    return spark.createDataFrame(rows, "threshold int, min_score int, label string, advice string")
