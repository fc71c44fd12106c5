"""Labelled documents, all of them or a bounded sample."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stratalens.llm.text import only


def agreed_labels(labels: DataFrame, learn: Column, id_col: str, label_col: str) -> DataFrame:
    """Ids with their label (``doc_id, label``) for which ``learn`` (on ``doc_id``) holds and whose rows all agree on a
    label of 0 or 1."""
    rows = only(labels, doc_id=id_col, label=label_col).where(learn & F.col("label").isin(0, 1))
    agreed = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    return agreed.select("doc_id", F.col("label").cast("int").alias("label"))


def labelled_sample(
    labels: DataFrame, learn: Column, id_col: str, label_col: str, sample: int
) -> tuple[DataFrame, dict[int, int]]:
    """Ids with their label (``doc_id, label``), about ``sample / 2`` of each class at most, and the number of ids
    of each class.

    Only ids of ``agreed_labels`` count. The draw is a hash of the id, so a repeated task draws the same ids; its size is bounded
    by ``sample``, not by the table.
    """
    agreed = agreed_labels(labels, learn, id_col, label_col)
    sizes = {r["label"]: r["n"] for r in agreed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("label") == label, min(1.0, sample / 2 / n)).otherwise(rate)
    return agreed.where(draw < rate), sizes
