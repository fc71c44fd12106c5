"""Quoted csv records that may run over several lines, read by many tasks a file.

A line break belongs to a field when an odd number of quotes stands before it. Each task knows the quotes of its own
block; the parity before a block follows from those of the blocks before it, one row a block. So a file of any size is split over tasks, and a record
may begin in one block and end in another. Quotes stand around fields and, doubled, inside quoted fields only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.operators.strata import join_groups

#: A record of more lines means that a quote is missing.
MOST_LINES = 10_000

# Characters that csv text does not hold: between fields, and around quoted parts.
_BETWEEN, _AROUND = "\x00", "\x01"


def quoted_records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """``file, place, value``: every record of the text files below ``path``, its lines joined by line feeds.

    ``place`` orders the records of a file. A record of more than about ``most_lines`` lines is an error when it is read, so that a missing quote
    cannot gather the rest of a file in one row.
    """
    read = spark.read.text(path)
    lines = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    in_block = Window.partitionBy("file", "block").orderBy("line")
    upto, before = (in_block.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    # Parity after each line if the block began outside (0) or inside (1) quotes: their sum is odd.
    local = lines.withColumn("odd", (quotes % 2).cast("int")).withColumn("after", (F.sum("odd").over(upto) % 2).cast("int"))

    blocks = local.groupBy("file", "block").agg(
        F.sum("odd").alias("odd"), F.count_if(F.col("after") == 0).alias("ends_outside"), F.count_if(F.col("after") == 1).alias("ends_inside")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.withColumn("inside", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
    ends = F.when(F.col("inside") == 0, F.col("ends_outside")).otherwise(F.col("ends_inside"))
    blocks = blocks.withColumn("first", F.coalesce(F.sum(ends).over(earlier), F.lit(0))).select("file", "block", "inside", "first")

    known = join_groups(local, blocks, ["file", "block"])
    known = known.withColumn("open", (F.col("after") + F.col("inside")) % 2)
    closed = F.when(F.col("open") == 0, 1).otherwise(0)
    known = known.withColumn("record", F.col("first") + F.coalesce(F.sum(closed).over(before), F.lit(0)))
    begun = F.coalesce(F.lag("open").over(in_block), F.col("inside")) == 0
    row = F.row_number().over(in_block)
    known = known.withColumn("begun", begun).withColumn("row", row)
    since = F.col("row") - F.coalesce(F.max(F.when(F.col("begun"), F.col("row"))).over(upto), F.lit(0))
    lost = F.raise_error(F.concat(F.lit(f"a record of more than {most_lines} lines, a quote is missing in "), F.col("file"))).cast("bigint")
    known = known.withColumn("record", F.when(since > most_lines, lost).otherwise(F.col("record")))
    place = F.struct("block", "line").alias("place")
    alone = F.col("begun") & (F.col("open") == 0)
    several = known.where(~alone).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    joined = several.select(
        "file",
        F.struct(F.col("lines")[0]["block"].alias("block"), F.col("lines")[0]["line"].alias("line")).alias("place"),
        F.array_join(F.transform("lines", lambda line: line["value"]), "\n").alias("value"),
    )
    return known.where(alone).select("file", place, "value").unionByName(joined)


def fields_of(record: Column | str, delimiter: str = ",") -> Column:
    """The fields of a csv record as texts: without quotes around them and blanks outside quotes. Linear in its length."""
    parts = F.split(record, '"')
    last = F.size(parts) - 1

    def mark(part: Column, i: Column) -> Column:
        # Between two quotes every other part; an empty part between two quoted ones stands for a doubled quote.
        quoted = F.concat(F.lit(_AROUND), part, F.lit(_AROUND))
        doubled = (part == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, quoted).when(doubled, F.lit('"')).otherwise(F.replace(part, F.lit(delimiter), F.lit(_BETWEEN)))

    fields = F.split(F.array_join(F.transform(parts, mark), ""), _BETWEEN, -1)
    return F.transform(fields, lambda f: F.replace(F.trim(f), F.lit(_AROUND), F.lit("")))
