"""Operator 7: quality rules with verdicts by host.

Each document is tested against rules on its whole text. Failures are summed
by host, each host's failure rate of each rule is shrunk towards the corpus
with a beta prior whose two parameters are fitted to all hosts by moments, and
the host's verdict is joined back to its documents.

A document is rejected if it fails a hard rule, or if it fails a soft rule and
its host is bad. A host is bad if the shrunk rate of any rule is above
``host_limit``. A clean document of a bad host stays.

Texts are measured once: the flags are written, summed by host, and judged by the hosts' verdicts.

A host that is a URL counts by its domain, in lower case and without ``www.``; any other value is taken as it is. The words that are unlike
grow with a text's length by a power, so ``repeated_words`` asks for
their number to follow that of all words to the power 2/3: clean texts of any length pass.

Defined cases: a null text counts as an empty one, which fails ``empty``
(hard); a null host is the host ``(none)``; texts of any length are measured whole; repeated rows count each; an empty
table gives no rows; columns other than those named, whatever their names, are ignored by
:func:`assess` and kept by :func:`accepted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.durable import cut, written
from bundlewright.llm.common import small_enough, sole, table

HARD = ("empty", "symbols", "shouting", "pipes", "capitals", "repeated_words", "repeated_lines")
SOFT = ("short", "word_length", "some_repeated_lines")
RULES = HARD + SOFT
HOST_LIMIT = 0.4


def _metrics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    distinct_words = F.array_distinct(F.filter(F.split(F.lower(text), "[ \t\n\r]+"), lambda w: w != ""))

    def left(drop: str) -> Column:
        return F.length(F.regexp_replace(text, drop, ""))

    return {
        "_q_chars": F.length(text),
        "_q_words": F.size(words),
        "_q_unique": F.size(distinct_words),
        "_q_lines": F.size(lines),
        "_q_unlike": F.size(F.array_distinct(lines)),
        "_q_signs": left(r"[^#$%&*+<=>@\\^_{|}~]+"),
        "_q_bangs": left("[^!]+"),
        "_q_bars": left("[^|]+"),
        "_q_upper": left("[^A-Z]+"),
        "_q_lower": left("[^a-z]+"),
    }


#: One condition for each rule.
CONDITIONS = {
    "empty": "_q_words = 0",
    "symbols": "4 * _q_signs > _q_words",
    "shouting": "4 * _q_bangs > _q_words",
    "pipes": "10 * _q_bars > _q_words",
    "capitals": "_q_words >= 5 AND 10 * _q_upper > 3 * (_q_upper + _q_lower)",
    "repeated_words": "_q_words >= 20 AND 5 * CAST(_q_unique AS DOUBLE) * _q_unique * _q_unique < 13 * CAST(_q_words AS DOUBLE) * _q_words",
    "repeated_lines": "_q_lines >= 4 AND 2 * (_q_lines - _q_unlike) > _q_lines",
    "short": "_q_words < 3",
    "word_length": "_q_words > 0 AND (_q_chars > 20 * _q_words OR _q_chars < 3 * _q_words)",
    "some_repeated_lines": "_q_lines >= 4 AND 10 * (_q_lines - _q_unlike) > 3 * _q_lines",
}


def host_of(value: Column) -> Column:
    """The domain of a URL; any other value as it is, and ``(none)`` for null."""
    value = value.cast("string")
    domain = F.regexp_replace(F.lower(F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.coalesce(F.when(domain != "", domain).otherwise(value), F.lit("(none)"))


def _own(columns: list[str]) -> str:
    """What the operator's own columns start with, and none of the given."""
    start = "_q_"
    while any(c.lower().startswith(start) for c in columns):
        start = "_" + start
    return start


def _flagged(docs: DataFrame, text: str, host: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then the host, the number of words and 0 or 1 for each rule."""
    q = _own(keep)
    kept = [F.col(f"`{k}`") for k in keep]
    metrics = {name.replace("_q_", q): column.cast("long") for name, column in _metrics(F.col(f"`{text}`")).items()}
    measured = docs.select(*kept, host_of(F.col(f"`{host}`")).alias(f"{q}host"), *(column.alias(name) for name, column in metrics.items()))
    flags = [F.expr(f"CAST({CONDITIONS[r].replace('_q_', q)} AS INT)").alias(f"{q}f_{r}") for r in RULES]
    return measured.select(*kept, f"{q}host", f"{q}words", *flags)


def host_rates(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, rule, n, failed, rate): the shrunk rate of each rule on each host.

    With ``mu`` the corpus's rate of a rule and ``v`` the variance of the hosts'
    rates around it, both weighted by documents, less what sampling alone
    explains, the prior's strength is ``mu (1 - mu) / v - 1``, from 1 to 10^6.
    """
    return _rates(_flagged(docs, text, host, []), "_q_")


def _rates(flags: DataFrame, q: str) -> DataFrame:
    sums = flags.groupBy(F.col(f"{q}host").alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"{q}f_{r}").alias(r) for r in RULES))
    stacked = ", ".join(f"'{r}', {r}" for r in RULES)
    by_rule = cut(sums.select("host", "n", F.expr(f"stack({len(RULES)}, {stacked}) AS (rule, failed)")))
    whole = by_rule.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("mu"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("hosts")
    )
    spread = (
        by_rule.join(F.broadcast(whole), "rule")
        .groupBy("rule", "mu", "total", "hosts")
        .agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.col("mu"), F.lit(2))).alias("squares"))
        .withColumn("pq", F.col("mu") * (1 - F.col("mu")))
        .withColumn("between", F.col("squares") / F.col("total") - F.col("pq") * (F.col("hosts") - 1) / F.col("total"))
        .withColumn(
            "strength",
            F.when(F.col("between") > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("pq") / F.col("between") - 1)))
            .otherwise(F.lit(1e6)),
        )
        .select("rule", "mu", "strength")
    )
    rate = (F.col("failed") + F.col("mu") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return by_rule.join(F.broadcast(spread), "rule").select("host", "rule", "n", "failed", F.round(rate, 6).alias("rate"))


def _judged(flags: DataFrame, q: str, host_limit: float) -> DataFrame:
    """With the host's worst rate and the verdicts. A few hosts are broadcast; beyond a counted limit both sides are shuffled and adaptive execution splits hot hosts."""
    worst = _rates(flags, q).groupBy(F.col("host").alias(f"{q}host")).agg(F.max("rate").alias(f"{q}worst"))
    worst = cut(worst.withColumn(f"{q}bad", F.col(f"{q}worst") > host_limit))
    judged = flags.join(F.broadcast(worst) if small_enough(worst.count()) else worst, f"{q}host", "left")
    hard = F.greatest(*(F.col(f"{q}f_{r}") for r in HARD))
    soft = F.greatest(*(F.col(f"{q}f_{r}") for r in SOFT))
    return judged.withColumn(f"{q}keep", ~((hard == 1) | ((soft == 1) & F.col(f"{q}bad"))))


def assess(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT
) -> DataFrame:
    """One row for each document: its host, the rules it fails, its host's worst shrunk rate and the verdict."""
    narrow = sole(docs, id_col, text, host).toDF("doc_id", "text", "host")
    judged = _judged(written(_flagged(narrow, "text", "host", ["doc_id"])), "_q_", host_limit)
    failed = F.concat_ws(",", *(F.when(F.col(f"_q_f_{r}") == 1, F.lit(r)) for r in RULES))
    return judged.select(
        "doc_id",
        F.col("_q_host").alias("host"),
        F.col("_q_words").alias("n_words"),
        failed.alias("failed_rules"),
        F.col("_q_worst").alias("host_worst_rate"),
        F.col("_q_bad").alias("host_bad"),
        F.col("_q_keep").alias("keep"),
    )


def accepted(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    q = _own(docs.columns)
    judged = _judged(written(_flagged(docs, text, host, docs.columns)), q, host_limit)
    return judged.where(f"{q}keep").select(*(f"`{c}`" for c in docs.columns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


def sql(source: str = "documents") -> str:
    """DuckDB SQL for :func:`assess` over ``source``, with rules of its own wording."""
    ws = r"'[ \t\n\r]+'"
    tests = {
        "empty": "n = 0",
        "symbols": "signs > n / 4",
        "shouting": "bangs > n / 4",
        "pipes": "bars > n / 10",
        "capitals": "n > 4 AND upper_ / nullif(upper_ + lower_, 0) > 0.3",
        "repeated_words": "n >= 20 AND 5.0::DOUBLE * u * u * u < 13.0::DOUBLE * n * n",
        "repeated_lines": "l > 3 AND (l - ul) / l > 0.5",
        "short": "n <= 2",
        "word_length": "n > 0 AND NOT chars / n BETWEEN 3 AND 20",
        "some_repeated_lines": "l > 3 AND (l - ul) / l > 0.3",
    }
    flags = ", ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END AS f_{r}" for r, t in tests.items())
    sums = ", ".join(f"sum(f_{r}) AS f_{r}" for r in RULES)
    stack = " UNION ALL ".join(f"SELECT host, n, '{r}' AS rule, f_{r} AS failed FROM hosts" for r in RULES)
    names = ", ".join(f"CASE WHEN f_{r} = 1 THEN '{r}' END" for r in RULES)
    hard, soft = (f"greatest({', '.join(f'f_{r}' for r in group)})" for group in (HARD, SOFT))
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(text, '') AS text FROM {source}
), measured AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]')
      THEN regexp_replace(lower(regexp_extract(source, '://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') ELSE source END AS host, length(text) AS chars,
    len(list_filter(string_split_regex(text, {ws}), lambda w: w <> '')) AS n,
    len(list_distinct(list_filter(string_split_regex(lower(text), {ws}), lambda w: w <> ''))) AS u,
    len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS l,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) AS ul,
    length(regexp_replace(text, '[^#$%&*+<=>@\\^_{{|}}~]+', '', 'g')) AS signs,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS bangs,
    length(regexp_replace(text, '[^|]+', '', 'g')) AS bars,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper_,
    length(regexp_replace(text, '[^a-z]+', '', 'g')) AS lower_
  FROM texts
), flagged AS (SELECT doc_id, host, n AS n_words, {flags} FROM measured),
hosts AS (SELECT host, count(*) AS n, {sums} FROM flagged GROUP BY host),
by_rule AS ({stack}),
whole AS (SELECT rule, sum(failed) / sum(n) AS mu, sum(n) AS total, count(*) AS hosts FROM by_rule GROUP BY rule),
spread AS (
  SELECT b.rule, mu, mu * (1 - mu) AS pq,
    sum(n * power(failed / n - mu, 2)) / total - mu * (1 - mu) * (hosts - 1) / total AS between_
  FROM by_rule b JOIN whole w ON b.rule = w.rule GROUP BY b.rule, mu, total, hosts
), prior AS (
  SELECT rule, mu, CASE WHEN between_ > 0 THEN least(1e6::DOUBLE, greatest(1.0::DOUBLE, pq / between_ - 1)) ELSE 1e6::DOUBLE END AS strength FROM spread
), worst AS (
  SELECT host, max(round((failed + mu * strength) / (n + strength), 6)) AS rate
  FROM by_rule b JOIN prior p ON b.rule = p.rule GROUP BY host
)
SELECT f.doc_id, f.host, CAST(f.n_words AS BIGINT) AS n_words, concat_ws(',', {names}) AS failed_rules,
  w.rate AS host_worst_rate, w.rate > {HOST_LIMIT} AS host_bad,
  NOT ({hard} = 1 OR ({soft} = 1 AND w.rate > {HOST_LIMIT})) AS keep
FROM flagged f JOIN worst w ON f.host = w.host"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": sql()}
