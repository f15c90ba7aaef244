"""Small pieces that several corpus operators share: word rules, null-safe keys, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and words as the query contracts define them (ASCII white space only).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def null_last(c: Column) -> Column:
    """A never-null string that groups, joins and sorts as `c` by code point with null last."""
    return F.coalesce(F.concat(F.lit("a"), c.cast("string")), F.lit("b"))


def bucket_of(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that equal rows of documents share: enough to find a row again at any corpus size."""
    parts = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    nulls = F.concat(*[p.isNull().cast("string") for p in parts])
    return [F.xxhash64(*parts, nulls).alias("_k1"), F.xxhash64(F.lit("second"), nulls, *reversed(parts)).alias("_k2")]


def keyed_rows(df: DataFrame) -> DataFrame:
    """_row (the whole row, whatever its columns are called), _k1 and _k2."""
    return df.select(F.struct("*").alias("_row"), *row_key(df))
