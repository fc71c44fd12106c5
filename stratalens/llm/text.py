"""Text expressions and helpers that several corpus operators share."""

from __future__ import annotations

import zlib

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The blanks that separate words and are stripped from lines: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters beyond ASCII that a Unicode lower-casing may change (unassigned ones included, as
#: the tables of two libraries may differ in age).
_CASED_BEYOND_ASCII = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone.

    ``lower`` is much faster than ``translate`` and agrees with it unless the text holds a cased
    character beyond ASCII.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain | ~text.rlike(_CASED_BEYOND_ASCII), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has no remainder (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def salt_of(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def words(text: str) -> list[bytes]:
    """A-Z lower-cased words between blanks, as UTF-8; bytes lower and split by ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def only(frame: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone under fixed names, so that no other column can clash."""
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
