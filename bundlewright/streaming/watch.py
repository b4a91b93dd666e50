"""Rebuilding an index whenever files of a folder change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bundlewright.functions.paths import has_extension
from bundlewright.operators.chunking import LINES, OVERLAP
from bundlewright.operators.index import build_index
from bundlewright.sources.files import EXTENSIONS, read_tree

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def relevant(events: DataFrame, out: str, extensions=EXTENSIONS) -> DataFrame:
    """Events on files with one of the extensions that aren't part of the index."""
    inside = F.contains(F.col("path"), F.lit(out.rstrip("/") + "/"))
    return events.where(~inside & has_extension(F.col("path"), extensions))


def rebuild(spark: SparkSession, root: str, out: str, extensions=EXTENSIONS, excludes=(), lines: int = LINES, overlap: int = OVERLAP) -> None:
    build_index(read_tree(spark, root, extensions, excludes), lines, overlap).save(out)


def watch(
    spark: SparkSession,
    root: str,
    out: str,
    checkpoint: str,
    extensions=EXTENSIONS,
    excludes=(),
    lines: int = LINES,
    overlap: int = OVERLAP,
    debounce: str = "500 milliseconds",
    once: bool = False,
) -> StreamingQuery:
    """Build the index, then again for each batch of new files; each build lists the whole folder.

    A file source reports new files; an edit counts if it leaves a file of another name or time, a deletion at the
    next build.
    """
    rebuild(spark, root, out, extensions, excludes, lines, overlap)
    events = (
        spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("allowOverwrites", "true").load(root)
    )

    def batch(changed: DataFrame, number: int) -> None:
        if not changed.isEmpty():
            rebuild(spark, root, out, extensions, excludes, lines, overlap)

    writer = relevant(events.select("path", "modificationTime"), out, extensions).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()
