"""Reading the tables, the shared folder, and word rules that several operators use."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.session import give_back, materialise, new_path, prepare

__all__ = ["WORD", "WORD_SQL", "give_back", "materialise", "new_path", "prepare", "read_table", "utf8", "word_array"]

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_SQL = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """All words of a text in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def utf8(text: str) -> bytes:
    """UTF-8 bytes; a lone surrogate, which no valid file holds, becomes a question mark."""
    return text.encode("utf-8", "replace")
