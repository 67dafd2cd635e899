"""Quality rules with host verdicts, in DataFrame operations only.

Measures. For each text: words (runs without white space), their characters, symbol signs,
repeated lines and the words inside 3-word windows that occur twice or more. Windows are
compared by 64-bit hashes, sorted within the row, so a long text costs n log n and nothing
is shuffled.

Hosts. For each host and rule, the share of its documents that fail is shrunk towards all
hosts: rate = (fails + a) / (documents + a + b), where a and b are the beta prior fitted to
the hosts' rates by moments (strength PRIOR where the rates don't vary). A host is rejected
if the shrunk rate of a rule is over LIMIT. Hosts are summed map-side first, so that one with a
third of the documents is one row a task in the exchange; the verdicts go back by a
broadcast up to HOSTS hosts and by a shuffled join beyond.

Verdict. A document that fails a base rule goes. One of a rejected host must pass all rules;
one of any other host needs the base rules only. So a clean document is kept wherever it is.

Null and empty texts have no words (and so fail). A null host is a host like any other.
Repeated rows are judged and kept each by itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import settled

LIMIT = 0.5
PRIOR = 10.0
HOSTS = 100_000

# White space of the words, the signs counted as symbols
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = "[ \\t-\\r]+"

BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
SOFT_RULES = {"symbols": "10 * n_symbols > n_words", "lines": "2 * n_dup_lines > n_lines", "letters": "word_chars < 2 * n_words OR word_chars > 15 * n_words"}
RULES = BASE_RULES | SOFT_RULES
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures, n_lines, and ``fails``: a struct with a boolean for each rule."""
    own = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", F.filter(F.split(whole, WORD_BREAK), lambda x: x != ""))
    df = df.withColumn("__lines", F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    )
    df = df.withColumn(
        "__windows",
        F.expr("CASE WHEN size(__hashes) > 2 THEN transform(sequence(0, size(__hashes) - 3), i -> xxhash64(__hashes[i], __hashes[i + 1], __hashes[i + 2])) ELSE cast(array() AS array<bigint>) END"),
    )
    df = df.withColumn("__some", F.size(F.array_distinct("__windows")) < F.size("__windows"))
    # The windows of a text with repeats, sorted by hash and place
    df = df.withColumn("__sorted", F.expr("CASE WHEN __some THEN sort_array(transform(__windows, (h, i) -> struct(h AS h, i AS i))) END"))
    df = df.withColumn(
        "__at",
        F.expr(
            "CASE WHEN __some THEN sort_array(filter(transform(__sorted, (s, k) -> CASE WHEN (k > 0 AND s.h = __sorted[greatest(k - 1, 0)].h) "
            "OR (k < size(__sorted) - 1 AND s.h = __sorted[least(k + 1, size(__sorted) - 1)].h) THEN s.i END), i -> i IS NOT NULL)) END"
        ),
    )
    df = df.withColumn("n_repeat_words", F.expr("CASE WHEN __some THEN aggregate(transform(__at, (i, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, i - __at[greatest(k - 1, 0)]) END), 0L, (a, x) -> a + x) ELSE 0L END"))
    fails = F.struct(*[F.expr(rule).alias(name) for name, rule in RULES.items()])
    return df.select(*own, *MEASURES, "n_lines", fails.alias("fails"))


def hosts(measures: DataFrame, host: str) -> DataFrame:
    """A row for each host: n_docs, the shrunk rate of each rule, and rejected."""
    table = settled(measures.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"fails.{r}").cast("long")).alias(r) for r in RULES]))
    moments = table.agg(*[f(F.col(r) / F.col("n_docs")).alias(f"{r}_{n}") for r in RULES for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    rates = {}
    for r in RULES:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        s = max(m * (1 - m) / v - 1, 0.0) if v > 1e-12 else PRIOR
        rates[r] = (F.col(r) + m * s) / (F.col("n_docs") + s)
    return table.select("host", "n_docs", *[e.alias(r) for r, e in rates.items()]).withColumn("rejected", F.greatest(*RULES) > LIMIT)


def judged(measures: DataFrame, host: str) -> DataFrame:
    """Measured rows with base_failed and kept. Pass a written table: it is read twice."""
    table = hosts(measures, host).filter("rejected").select(F.col("host").alias("__host"), "rejected")
    table = settled(table)
    if table.count() <= HOSTS:
        table = F.broadcast(table)
    out = measures.join(table, measures[host].eqNullSafe(table["__host"]), "left")
    base = F.greatest(*[F.col(f"fails.{r}") for r in BASE_RULES])
    every = F.greatest(*[F.col(f"fails.{r}") for r in RULES])
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~(F.coalesce("rejected", F.lit(False)) & every)).drop("__host", "rejected")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The measures and verdict of every row."""
    table = settled(measured(docs.select(id_col, host, text), text).drop(text))
    return judged(table, host).select(id_col, *MEASURES, "base_failed", "kept")


def accepted(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their own columns, whatever their names are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text).alias("__text"), F.col(host).alias("__source"))
    table = settled(measured(packed, "__text").drop("__text"))
    return judged(table, "__source").filter("kept").select("__doc.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, source, text,
         list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[ \t\n\x0B\f\r]*')) AS lines
  FROM d),
p AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM a),
win AS (
  SELECT doc_id, i, w || chr(10) || lead(w, 1) OVER x || chr(10) || lead(w, 2) OVER x AS s
  FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win WHERE s IS NOT NULL),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM many, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT a.doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM a LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 10 * n_symbols > n_words AS r3, 2 * n_dup_lines > n_lines AS r4,
         word_chars < 2 * n_words OR word_chars > 15 * n_words AS r5 FROM m),
h AS (
  SELECT source, r, count(*) AS n, sum(CAST(fail AS BIGINT)) AS c
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS r, unnest([r1, r2, r3, r4, r5]) AS fail FROM f) GROUP BY source, r),
prior AS (
  SELECT r, m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0) ELSE 10 END AS s
  FROM (SELECT r, avg(c / n) AS m, var_pop(c / n) AS v FROM h GROUP BY r)),
bad AS (SELECT source, bool_or((c + m * s) / (n + s) > 0.5) AS rejected FROM h JOIN prior USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
       NOT (r1 OR r2) AND NOT (rejected AND (r1 OR r2 OR r3 OR r4 OR r5)) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""
