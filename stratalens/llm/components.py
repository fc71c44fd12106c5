"""Connected components of links, and values shared within large groups."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalens.llm.text import salt_of
from stratalens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node that ``links`` (``a, b``) mentions: the smallest node it reaches.

    Every link is hung on the smallest neighbour, first for larger neighbours, then for smaller ones,
    until nothing moves; the number of rounds grows with the logarithm of the longest chain. Minima are
    combined before they are shuffled, and each round is written, so a lost executor costs one
    round at most.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        # Larger neighbours of a node move to the least node around it.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node and its smaller neighbours move to the least of them.
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def with_least(rows: DataFrame, group: str, value: str, name: str, salts: int = 64) -> DataFrame:
    """``rows`` with the least ``value`` of their ``group`` as ``name``; rows without group get null.

    The minimum returns to the rows by group and salt, so that no task meets a whole large group.
    """
    salted = rows.withColumn("__salt", salt_of(F.col(value), salts))
    parts = salted.where(F.col(group).isNotNull()).groupBy(group, "__salt").agg(F.min(value).alias(name))
    parts = parts.withColumn(name, F.min(name).over(Window.partitionBy(group)))
    return salted.join(parts, [group, "__salt"], "left").drop("__salt")
