"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where vocabulary files are, unless the session's setting ``spark.bundlewright.tokenizers`` names another folder that executors have.
TOKENIZERS = "/opt/tokenizers"


def tokenizers(spark: SparkSession) -> str:
    """The folder of vocabulary files for this session."""
    return spark.conf.get("spark.bundlewright.tokenizers", TOKENIZERS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(rows: int, limit: int = 200_000) -> bool:
    """Whether a counted side may be broadcast; beyond the limit it is shuffled."""
    return rows <= limit


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until the input has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sole(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that others can't clash with its own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
