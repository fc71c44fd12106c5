"""Writers for result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "parquet", "orc")


def export(frame: DataFrame, path: str, kind: str = "csv", metadata: Mapping[str, str] | None = None, mode: str = "overwrite") -> None:
    """Write a result; ``metadata`` is kept beside it as one json row."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if kind == "csv":
        arrays = [name for name, kind_ in frame.dtypes if kind_.startswith("array")]
        for name in arrays:
            frame = frame.withColumn(name, F.concat_ws(", ", name))
    writer = frame.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    if metadata:
        spark = frame.sparkSession
        row = spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in metadata.items()])
        row.coalesce(1).write.mode(mode).json(f"{path.rstrip('/')}_metadata")


def write_by(frame: DataFrame, path: str, columns: Sequence[str] = ("dimension",), kind: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per dimension (or survey); rows of a large folder stay spread over several files."""
    writer = frame.write.mode(mode).format(kind).partitionBy(*columns)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_variances(variances: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Variance lookup ``survey, dimension, stratum, variance``: one row or json record per stratum."""
    if kind not in ("parquet", "json"):
        raise ValueError("format must be parquet or json")
    write_by(variances.select("survey", "dimension", "stratum", "variance"), path, ["survey"], kind, mode)
