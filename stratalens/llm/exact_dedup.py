"""Exact duplicates by salted combining of whole texts, in DataFrame operations only."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalens.llm.text import ascii_lower, only, salt_of

#: A group of copies is combined in this many parts before the parts meet.
SALTS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Which row of every group of equal texts stays.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Returns
    ``doc_id, keep_id, group_size, kept, text_sha256`` for every row: the largest ``doc_id`` of the
    group stays.

    Copies meet three times, each time as whole texts next to their digest: in the task that reads
    them (the partial aggregate), in one of ``salts`` parts of their group, and, one row a part, in
    the whole group. The group's decision returns to the documents by digest and part, so no task
    meets a whole group of copies. Should one digest ever stand for different texts, its documents
    are joined with the text as well; that side is empty otherwise and costs no scan.

    Edge cases: a null id is smaller than any other, and a group with null ids only keeps one of
    them; of rows that repeat id and text, all are counted and one is kept; an empty table gives an
    empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col).select(
        "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"), salt_of(F.col("doc_id"), salts).alias("salt")
    )
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    parts = base.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    same_text, same_digest = Window.partitionBy("digest", "text"), Window.partitionBy("digest")
    groups = (
        parts.repartition("digest")
        .withColumn("keep_id", F.max("last").over(same_text))
        .withColumn("group_size", F.sum("n").over(same_text))
        .withColumn("shared", F.min("text").over(same_digest) != F.max("text").over(same_digest))
    )
    groups = groups.select(
        "digest", "salt", "keep_id", "group_size", "shared", F.when(F.col("shared"), F.col("text")).alias("shared_text")
    )
    sure = groups.where("NOT shared").drop("shared", "shared_text")
    found = base.select("doc_id", "digest", "salt").join(sure, ["digest", "salt"])
    # Digests of different texts: none for SHA-256, so a broadcast of them is bounded.
    unsure = groups.where("shared").withColumnRenamed("shared_text", "text").drop("shared")
    rest = base.join(F.broadcast(unsure), ["digest", "salt", "text"]).select(
        "digest", "salt", "doc_id", "keep_id", "group_size"
    )
    once = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id").orderBy("keep_id"))
    return found.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (once == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
