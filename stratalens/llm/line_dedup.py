"""Lines that many documents share, dropped from all but one of them, in DataFrame operations only."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalens.llm.text import BLANKS, ascii_lower, only, salt_of
from stratalens.session import materialize

SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(
    docs: DataFrame,
    min_docs: int = 3,
    min_chars: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
) -> DataFrame:
    """Positions of the lines to drop: ``doc_id, version, positions`` (ascending, from 0).

    A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of at least
    ``min_chars`` characters found in at least ``min_docs`` different ids is dropped everywhere but
    in the largest id that has it. Keys are compared by 128-bit hashes. Every key is counted in
    ``salts`` parts by document, and the verdict goes back to the parts, so a line of very many
    documents never meets in one task. ``version`` is a hash of the text: rows that repeat an id with
    other texts keep positions of their own.
    """
    lines = only(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").select(
        "doc_id",
        F.xxhash64("text").alias("version"),
        F.posexplode(_lines(F.col("text"))).alias("position", "line"),
    )
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)
    hashed = trimmed.select(
        "doc_id",
        "version",
        "position",
        F.unhex(F.md5(ascii_lower(F.col("line")))).alias("hash"),
        salt_of(F.col("doc_id"), salts).alias("salt"),
    )
    rows = materialize(hashed).repartition("hash", "salt")
    parts = rows.groupBy("hash", "salt").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    same = Window.partitionBy("hash")
    verdicts = (
        parts.repartition("hash")
        .withColumn("docs", F.sum("n").over(same))
        .withColumn("last", F.max("last").over(same))
        .where(F.col("docs") >= min_docs)
        .select("hash", "salt", "last")
    )
    dropped = rows.join(verdicts, ["hash", "salt"]).where(F.col("doc_id") != F.col("last"))
    return dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("position")).alias("positions"))


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 3,
    min_chars: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    carry: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with its kept lines: ``doc_id, kept_text, n_lines, n_dropped``, and with ``carry`` the whole
    row of ``docs`` but its text as the struct ``row``.

    Texts are split at line feeds; the kept lines are put together again in their order. Between
    two dropped positions lies one slice of the lines, so the work grows with the text alone.

    Edge cases: a null or empty text is one empty line; a row without id takes no part and keeps all
    its lines; rows that repeat an id count as one document; an empty table gives an empty result;
    other columns are ignored.
    """
    named = {"doc_id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`"), "version": F.xxhash64(F.col(f"`{text_col}`"))}
    if carry:
        named["row"] = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    base = docs.select(*[c.alias(name) for name, c in named.items()])
    found = base.join(repeated_lines(docs, min_docs, min_chars, id_col, text_col, salts), ["doc_id", "version"], "left")
    others = ["row"] if carry else []
    split = found.select(*others, "doc_id", "text", "positions", _lines(F.col("text")).alias("lines"))
    starts = F.concat(F.array(F.lit(0)), F.transform("positions", lambda p: p + 1))
    ends = F.concat(F.col("positions"), F.array(F.size("lines")))
    slices = F.zip_with(starts, ends, lambda start, end: F.slice("lines", start + 1, end - start))
    kept = F.array_join(F.flatten(slices), "\n")
    return split.select(
        *others,
        "doc_id",
        F.when(F.col("positions").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
    )
