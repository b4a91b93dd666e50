"""The index: tables of chunks, postings and statistics, their build, storage and checks."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.errors import IndexFormatError
from bundlewright.functions.signatures import SLOTS, minhash
from bundlewright.functions.text import counted, tokens, unique_tokens
from bundlewright.operators.chunking import LINES, OVERLAP, chunks

FORMAT = "bundlewright-2"
TABLES = ("chunks", "postings", "term_stats", "doc_stats", "corpus_stats", "file_terms", "minhash")
#: Folders that saved postings are spread over by a hash of the term; a search opens those of its terms.
BUCKETS = 64
#: Chunks whose postings of one bucket are written by one task; more chunks are divided, so that a common term is no hot key.
CHUNKS_EACH = 2_000_000
#: Manifests and versions that stay after a save: readers of the one before may still be at work.
KEPT = 2


def postings(chunk_table: DataFrame, *names: str) -> DataFrame:
    """(term, chunk_id, tf, dl): dl, the chunk's number of tokens, is kept here to save scoring a join. Other ``names`` of a chunk may be there for its id. No shuffle."""
    names = names or ("chunk_id",)
    return _counted(chunk_table.select(*names, tokens(F.col("text")).alias("all")), *names)


def _counted(words: DataFrame, *names: str) -> DataFrame:
    each = words.select(*names, F.size("all").alias("dl"), F.explode(counted(F.col("all"))).alias("c"))
    return each.select("c.term", *names, "c.tf", "dl")


def term_stats(posting_table: DataFrame) -> DataFrame:
    """(term, df): in how many chunks each term is; ``posting_table`` has one row for each chunk of a term."""
    return posting_table.groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("df"))


def doc_stats(chunk_table: DataFrame, *names: str) -> DataFrame:
    """(chunk_id, dl) of the chunks that have a token, or other ``names`` for the id."""
    sizes = F.filter(F.array(F.size(tokens(F.col("text")))), lambda n: n > 0)  # a filter of rows would split each text again
    return chunk_table.select(*(names or ("chunk_id",)), F.explode(sizes).alias("dl"))


def corpus_stats(doc_table: DataFrame) -> DataFrame:
    """(n_docs, avgdl) in one row; the mean is at least 1."""
    return doc_table.agg(
        F.count(F.lit(1)).alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.sum("dl") / F.count(F.lit(1)), F.lit(0.0))).alias("avgdl")
    )


def file_terms(files: DataFrame) -> DataFrame:
    """(file, term): the distinct tokens of each whole file; the exact form of a filter by file."""
    return files.select("file", F.explode(unique_tokens(F.col("content"))).alias("term")).distinct()


def term_bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def signatures(chunk_table: DataFrame, k: int = SLOTS, *names: str) -> DataFrame:
    """(chunk_id, sig), or other ``names`` for the id; null for a chunk without tokens."""
    return chunk_table.select(*(names or ("chunk_id",)), minhash(unique_tokens(F.col("text")), k).alias("sig"))


@dataclass
class Index:
    """The tables of an index; plans until they are saved and loaded."""

    chunks: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    file_terms: DataFrame
    minhash: DataFrame
    #: Slots of signatures and whether chunks cover whole files, for a save.
    slots: int = SLOTS
    whole: bool = False

    @property
    def saved(self) -> bool:
        """Whether the tables are read from a saved index; else they are plans."""
        return "bucket" in self.postings.columns

    def save(self, path: str) -> None:
        """Write all tables to a folder of a new version, then a manifest of the next number: readers take the newest, and never see half of one.

        Texts are cut and split into tokens once: chunks are written first, then their tokens, and every other table is derived from those.
        Postings are spread over folders by a hash of the term and ordered by it within files, so a search opens the folders of its terms.
        """
        spark = self.chunks.sparkSession
        version = f"v-{uuid.uuid4().hex}"

        def put(name: str, df: DataFrame, *by: str) -> DataFrame:
            writer = df.write.option("parquet.bloom.filter.enabled#term", "true") if name == "postings" else df.write
            (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{version}/{name}")
            return spark.read.parquet(f"{path}/{version}/{name}")

        chunk_table = put("chunks", self.chunks)
        words = put("_words", chunk_table.select("chunk_id", "file", tokens(F.col("text")).alias("all")))
        parts = 1 + words.count() // CHUNKS_EACH
        posted = _counted(words.select("chunk_id", "all"), "chunk_id").withColumn("bucket", term_bucket(F.col("term")))
        posted = posted.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).sortWithinPartitions("bucket", "term", "chunk_id")
        put("term_stats", term_stats(put("postings", posted, "bucket")))
        put("corpus_stats", corpus_stats(put("doc_stats", words.select("chunk_id", F.size("all").alias("dl")).where("dl > 0"))))
        put("minhash", words.select("chunk_id", minhash(F.array_distinct("all"), self.slots).alias("sig")))
        put("file_terms", words.select("file", F.explode(F.array_distinct("all")).alias("term")).distinct() if self.whole else self.file_terms)
        fs, where = _file_system(spark, f"{path}/{version}/_words")
        fs.delete(where, True)
        numbers = _manifests(spark, path)
        manifest = json.dumps({"format": FORMAT, "version": version, "tables": list(TABLES)})
        _write_text(spark, f"{path}/manifest-{(numbers or [0])[-1] + 1:08d}.json", manifest)
        _prune(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """Open a saved index without reading its tables; a missing or foreign manifest is an error."""
        manifest = read_manifest(spark, path)
        return cls(**{name: spark.read.parquet(f"{path}/{manifest['version']}/{name}") for name in TABLES})

    def stats(self) -> DataFrame:
        """One row: files with a token, chunks, chunks with a token, their mean length, terms, signatures.

        Of plans whose chunks cover the files all are counted in one pass, by key: a row for each chunk's file and one for each of its terms.
        """
        if self.whole and not self.saved:
            words = self.chunks.select("file", tokens(F.col("text")).alias("all"))
            own = F.struct(F.lit(None).cast("string").alias("term"), "file", F.size("all").alias("dl"))
            terms = F.transform(F.array_distinct("all"), lambda t: F.struct(t.alias("term"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("dl")))
            keys = words.select(F.explode(F.concat(F.array(own), terms)).alias("x")).groupBy("x.term", "x.file")
            each = keys.agg(F.count_if(F.col("x.term").isNull()).alias("chunks"), F.count_if(F.col("x.dl") > 0).alias("docs"), F.sum("x.dl").alias("dl"))
            docs = F.coalesce(F.sum("docs"), F.lit(0))
            return each.agg(
                F.count_if(F.col("docs") > 0).alias("n_files"),
                F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"),
                docs.alias("n_docs"),
                F.round(F.greatest(F.lit(1.0), F.coalesce(F.sum("dl") / F.nullif(docs, F.lit(0)), F.lit(0.0))), 6).alias("avgdl"),
                F.count("term").alias("vocabulary"),
                docs.alias("n_signatures"),
            )
        counts = [
            self.file_terms.agg(F.count_distinct("file").alias("n_files")),
            self.chunks.agg(F.count(F.lit(1)).alias("n_chunks")),
            self.corpus_stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")),
            self.term_stats.agg(F.count(F.lit(1)).alias("vocabulary")),
            self.minhash.agg(F.count("sig").alias("n_signatures")),
        ]
        out = counts[0]
        for one in counts[1:]:
            out = out.crossJoin(one)
        return out


def build_index(files: DataFrame, lines: int = LINES, overlap: int = OVERLAP, syntax: bool = True, slots: int = SLOTS) -> Index:
    """The plans of all tables from files (file, content)."""
    table = chunks(files, lines, overlap, syntax)
    posted = postings(table)
    lengths = doc_stats(table)
    seen = table.select(F.explode(unique_tokens(F.col("text"))).alias("term"))
    return Index(table, posted, term_stats(seen), lengths, corpus_stats(lengths), file_terms(files), signatures(table, slots), slots, not syntax)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename to a name that nobody reads yet."""
    fs, where = _file_system(spark, path)
    _, beside = _file_system(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, where):
        raise IndexFormatError(f"{path} can't be written")


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests in a folder."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _prune(spark: SparkSession, path: str) -> None:
    """Delete all but the newest manifests and the versions that they name."""
    for number in _manifests(spark, path)[:-KEPT]:
        name = f"{path}/manifest-{number:08d}.json"
        try:
            version = read_manifest(spark, path, number)["version"]
            fs, where = _file_system(spark, f"{path}/{version}")
            fs.delete(where, True)
        except IndexFormatError:
            pass  # a broken manifest names no version
        fs, where = _file_system(spark, name)
        fs.delete(where, False)


def read_manifest(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The manifest of a number, the newest if none is given."""
    numbers = _manifests(spark, path)
    if not numbers:
        raise IndexFormatError(f"{path} has no manifest")
    _, where = _file_system(spark, f"{path}/manifest-{numbers[-1] if number is None else number:08d}.json")
    text = "".join(r["value"] for r in spark.read.text(where.toString()).collect())
    try:
        found = json.loads(text)
    except ValueError as wrong:
        raise IndexFormatError(f"the manifest of {path} can't be read") from wrong
    if not isinstance(found, dict) or found.get("format") != FORMAT or set(found.get("tables", ())) != set(TABLES):
        raise IndexFormatError(f"{path} isn't an index of format {FORMAT}")
    return found
