"""Tokens, lines, sizes and trigrams of text columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a token: what is neither alphabetic nor numeric nor an underscore.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}_]+"
#: Bytes of UTF-8 that a token has at least, before it is lower-cased.
TOKEN_BYTES = 3


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text in their order, repeats kept; null has none."""
    words = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    return F.transform(F.filter(words, lambda w: F.octet_length(w) >= TOKEN_BYTES), F.lower)


def unique_tokens(text: Column) -> Column:
    """The distinct tokens of a text."""
    return F.array_distinct(tokens(text))


def counted(words: Column) -> Column:
    """(term, tf) of each distinct one of an array of tokens, by term; null without any. Counted within the row, where equal ones stand together once sorted."""

    def runs(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def pairs(x: Column) -> Column:
        s, starts = x["s"], x["starts"]
        return F.transform(starts, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(s)) - at).alias("tf")))

    bound = F.transform(F.array(F.sort_array(words)), lambda s: F.when(F.size(s) > 0, F.struct(s.alias("s"), runs(s).alias("starts"))))
    return F.transform(bound, pairs)[0]


def lines_of(text: Column) -> Column:
    """The lines of a text, each without its end, be it LF or CR LF; text that ends with LF has no last empty line."""

    def whole(parts: Column) -> Column:  # bound once; else each use would split the text again
        return F.slice(parts, F.lit(1), F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))

    parts = F.transform(F.array(F.split(text, "\n")), whole)[0]
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("int")


def trigrams(text: Column) -> Column:
    """The distinct runs of three bytes, as numbers, which sets hash; none if there are fewer bytes."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    places = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))

    def runs_of(r: Column) -> Column:  # the bytes are bound once; else each run would encode the text again
        return F.transform(places, lambda i: F.conv(F.hex(F.substring(r, i, F.lit(3))), 16, 10).cast("int"))

    runs = F.transform(F.array(raw), runs_of)[0]
    return F.when(n >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<int>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Shared over all, of two arrays of trigrams; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, shared / every).otherwise(F.lit(0.0))


def three_digits(number: Column) -> Column:
    """As C writes ``%.3f``: the number itself is rounded, not its shortest digits, which ``format_string`` rounds."""
    written = F.call_function("format_number", number, F.lit("0.000"))
    return F.when(F.abs(number) == 0.0005, F.format_string("%.3f", number)).otherwise(written)  # the one that Java's format takes for a tie


def six_digits(number: Column) -> Column:
    """As SQL's ``round(number, 6)``: a million times the number is rounded, where Spark rounds its shortest digits."""
    return F.round(number * 1e6) / 1e6


def is_relevant(text: Column, needles: Column) -> Column:
    """Whether a lower-cased text has one of the needles in it."""
    lowered = F.lower(text)
    return F.exists(needles, lambda n: F.contains(lowered, n))


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters."""
    return F.substring(text, 1, n)


def classify_query(query: Column) -> Column:
    """Which kind of search suits a query: by syntax, by pattern, by meaning, or by words."""
    return (
        F.when(query.rlike(r"(^|\s)(fn|def|class|struct|impl|trait|enum|func|interface)\s+\w"), F.lit("ast"))
        .when(query.rlike(r"[\\\[\]{}()*+?|^$]"), F.lit("regex"))
        .when(F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")) > 3, F.lit("semantic"))
        .otherwise(F.lit("lexical"))
    )
