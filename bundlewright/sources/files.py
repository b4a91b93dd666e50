"""Trees of source files, lists of paths, golden queries and synthetic chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.errors import SourceError
from bundlewright.functions.paths import has_extension, is_denied, is_excluded
from bundlewright.functions.text import token_estimate
from bundlewright.operators.index import _file_system

EXTENSIONS = ("rs",)


def kept_paths(paths: DataFrame, extensions=EXTENSIONS, excludes=(), path: str = "path") -> DataFrame:
    """The rows whose path, relative to the root, is read: right extension, no denied folder, no excluding pattern."""
    p = F.col(f"`{path}`")
    return paths.where(has_extension(p, extensions) & ~is_denied(p) & ~is_excluded(p, excludes))


def read_tree(spark: SparkSession, root: str, extensions=EXTENSIONS, excludes=()) -> DataFrame:
    """(file, content) of a folder's files, paths relative to it; empty and non-UTF-8 files are left out.

    Listing and filtering use the paths alone; contents are read for the files that are left.
    """
    fs, where = _file_system(spark, root)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise SourceError(f"{root} is not a folder")
    base = fs.resolvePath(where).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace("path", "^file:/+", "file:/")
    relative = F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(_bare(base)) + 1})")
    found = found.where(F.startswith(bare, F.lit(_bare(base)))).select(relative.alias("file"), "content")
    texts = kept_paths(found, extensions, excludes, "file").where(F.is_valid_utf8("content") & (F.length("content") > 0))
    return texts.select("file", F.decode("content", "UTF-8").alias("content"))


def _bare(uri: str) -> str:
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """(file): one path on each line, trimmed, without blanks, each once."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> ''").distinct()


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, needles, files) of tab-separated lines; ``#`` starts a comment, lists have commas, needles are lower-cased."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    cells = lines.select(F.split("value", "\t").alias("c"))

    def listed(n: int):
        return F.filter(F.transform(F.split(F.coalesce(F.get("c", F.lit(n)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    return cells.select(
        F.xxhash64(F.trim(F.get("c", F.lit(0)))).alias("query_id"),
        F.trim(F.get("c", F.lit(0))).alias("query"),
        F.transform(listed(1), F.lower).alias("needles"),
        listed(2).alias("files"),
    )


def synthetic_chunks(spark: SparkSession, n: int, per_file: int = 40, seed: int = 0xE5) -> DataFrame:
    """``n`` chunks of four lines: a term of their own, one that all share and one of ten thousand; the last file takes the rest."""
    files = max(1, n // per_file)
    f = F.least(F.floor(F.col("id") / per_file), F.lit(files - 1))
    c = F.col("id") - f * per_file
    r = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"))), 1, 7), 16, 10).cast("long") % 10_000
    text = F.format_string(
        "fn fn_%06d() {\n    let var_unique_%06d = compute_%04d_%04d();\n    handler_shared(filler_%05d);\n}\n", "id", "id", f, c, r
    )
    out = spark.range(n).select(
        F.format_string("synth/file_%06d.rs", f).alias("file"), (c * 4 + 1).cast("int").alias("start_line"), (c * 4 + 4).cast("int").alias("end_line"), text.alias("text")
    )
    return out.select(F.xxhash64("file", "start_line", F.lit(0)).alias("chunk_id"), "file", "start_line", "end_line", token_estimate(F.col("text")).alias("token_est"), "text")
