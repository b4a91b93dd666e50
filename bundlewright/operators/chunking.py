"""Cutting files into chunks: windows of lines, or whole syntactic units."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewright.functions.paths import language_of
from bundlewright.functions.text import lines_of, token_estimate

LINES, OVERLAP = 40, 8
COLUMNS = ("chunk_id", "file", "start_line", "end_line", "token_est", "text")


def _numbered(chunks: DataFrame) -> DataFrame:
    """With an id by file, place and ordinal (units that start on one line have their own), and a size."""
    return chunks.select(
        F.xxhash64("file", "start_line", "ordinal").alias("chunk_id"),
        "file",
        "start_line",
        "end_line",
        token_estimate(F.col("text")).alias("token_est"),
        "text",
    )


def line_windows(files: DataFrame, lines: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``lines`` lines, each of which has the last ``overlap`` lines of the one before; lines are numbered from 1.

    Files of null or empty content have none.
    """
    if lines < 1 or overlap < 0:
        raise ValueError("a window has at least one line, and no negative overlap")
    stride = max(1, lines - overlap)
    split = files.where(F.octet_length("content") > 0).select("file", lines_of(F.col("content")).alias("all"))
    split = split.withColumn("n", F.size("all"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - lines) / stride)).cast("int")
    windows = split.select("file", "all", "n", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("k") * stride
    return _numbered(
        windows.select(
            "file",
            (start + 1).alias("start_line"),
            F.least(start + lines, F.col("n")).alias("end_line"),
            F.lit(0).alias("ordinal"),
            F.array_join(F.slice("all", start + 1, F.lit(lines)), "\n").alias("text"),
        )
    )


# Syntactic units. Python has a parser at hand; for the others a scanner that knows
# strings, comments and brackets finds where a unit at the outermost level ends.

_MODIFIERS = r"(?:(?:pub(?:\([^)]*\))?|export|default|declare|abstract|async|unsafe|extern(?:\s*\"[^\"]*\")?|final|base|sealed|external)\s+)*"
_STARTS = {
    "rust": rf"{_MODIFIERS}(?:const\s+)?(?:fn|struct|enum|impl|trait|mod|const|static|type|macro_rules!)\b",
    "javascript": r"(?:export\b|async\s+function\b|function\b|class\b|let\b|const\b)",
    "typescript": r"(?:export\b|declare\b|abstract\s+class\b|async\s+function\b|function\b|class\b|let\b|const\b|interface\b|type\s+\w|enum\b|namespace\b|module\b)",
    "c": r"(?:#\s*define\s+\w+\(|[A-Za-z_][\w\s*]*?(?:[;({=\[]|$))",
    "dart": r"(?!(?:import|export|library|part)\b)[A-Za-z_@][\w<>?,.\s\[\]]*",
    "go": r"(?:func|type|const|var)\b",
}
_STARTS["tsx"] = _STARTS["typescript"]
_BLANK = re.compile(r"\s*(?://.*|/\*.*|\*.*|#\[.*|#!.*|@\w.*)?$")


def _blanked(text: str, language: str) -> str:
    """The text with the insides of strings and comments as blanks; line ends stay."""
    quotes = {"rust": r'"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.[^\']*|[^\'\\\n])\''}
    usual = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'' + (r"|`(?:\\.|[^`\\])*`" if language in ("javascript", "typescript", "tsx") else "")
    pattern = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + quotes.get(language, usual), re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _python_units(text: str) -> list[tuple[int, int]]:
    """(first, last) line of each function and class at the outermost level, decorators with them."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno) for n in body if isinstance(n, kinds)]


def _braced_units(text: str, language: str) -> list[tuple[int, int]]:
    start = re.compile(_STARTS[language])
    depth, first, units, ends_line = 0, None, [], language == "go"
    for number, line in enumerate(_blanked(text, language).split("\n"), 1):
        if first is None and depth == 0 and line[:1].strip() and not (language != "c" and _BLANK.match(line)) and start.match(line):
            first = number
        before, opened = depth, False
        for c in line:
            if c in "{([":
                depth, opened = depth + 1, True
            elif c in "})]":
                depth = max(0, depth - 1)
        if first is None or depth:
            continue
        closed = line.rstrip().endswith(("}", ";", ")", "},")) or (before and line.lstrip().startswith("}"))
        if closed or (ends_line and line.strip()) or (line.lstrip().startswith("#") and not line.rstrip().endswith("\\")):
            if not (language != "go" and line.rstrip().endswith(")") and not opened and not before):
                if line.rstrip().endswith(")") and language in ("c", "dart", "rust", "typescript", "tsx", "javascript"):
                    continue  # a signature whose body follows
                units.append((first, number))
                first = None
    if first is not None and not depth:
        units.append((first, len(text.rstrip("\n").split("\n"))))
    return units


def unit_spans(text: str, language: str | None) -> list[tuple[int, int]]:
    """(first, last) line, from 1, of each unit at the outermost level; empty if the language isn't known or nothing is found."""
    if language == "python":
        return _python_units(text)
    return _braced_units(text, language) if language in _STARTS else []


def syntax_units(files: DataFrame) -> DataFrame:
    """Chunks of whole units; files of unknown languages, or without a unit, have none.

    The units are found by a parser for Python and by a scanner of brackets for the
    rest, which is an approximation of a full grammar.
    """
    narrow = files.where("content is not null").select("file", "content", language_of(F.col("file")).alias("language")).where("language is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text, language in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = text.split("\n")
                for k, (a, b) in enumerate(unit_spans(text, language)):
                    rows.append((file, a, b, k, "\n".join(x.removesuffix("\r") for x in lines[a - 1 : b])))
            file, first, last, ordinal, texts = zip(*rows) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip((file, first, last, ordinal, texts), kinds)], ["file", "start_line", "end_line", "ordinal", "text"]
            )

    return _numbered(narrow.mapInArrow(run, "file string, start_line int, end_line int, ordinal int, text string"))


def chunks(files: DataFrame, lines: int = LINES, overlap: int = OVERLAP, syntax: bool = True) -> DataFrame:
    """Units where a file has any, else windows of lines."""
    if not syntax:
        return line_windows(files, lines, overlap)
    units = syntax_units(files)
    known = files.where(language_of(F.col("file")).isNotNull())
    rest = files.where(language_of(F.col("file")).isNull())
    without = known.join(units.select("file").distinct(), "file", "left_anti")
    return units.unionByName(line_windows(rest.unionByName(without), lines, overlap))
