"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Spans. Each kind is a pattern; its matches are leftmost and don't overlap. A span's place
comes from the text between the matches (split by the same pattern), in code points. A cheap
test for a fixed substring, or for a run of the right length, spares most texts the search.

Ownership. A candidate's value is hashed; over the whole corpus, each hash is counted in
distinct repositories and distinct owners (distinct pairs are reduced map-side before the
exchange, so a value that a third of all rows hold is no hot group). A value is an example, copied from
documentation, if EXAMPLE_OWNERS owners or more hold it, or two owners do in EXAMPLE_REPOS repositories or more (a
fork brings a second owner, a well-known example many repositories). Any other looks live, in however many
repositories one owner has it.

Verdicts. Spans of the base kinds are always reported; the further kinds are candidates, of which only live ones
are added. Live values of all kinds are what a redaction masks. Only examples are joined with the spans, the rows of an
example dealt over several tasks.

A null or empty text has no spans. Null owners or repositories count as one of their own.
Repeated rows are separate rows with equal spans. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import salted_join, settled

#: Owners from which a value counts as an example; repositories from which one of two owners does.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
#: Spans of a text whose places are summed at a time; it changes no result.
CHUNK = 128

# Kinds in order; (pattern, group of the value, least length of that group, substrings of which one is needed)
BASE_KINDS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, ("password", "passwd", "secret", "token", "api")),
    "access": ("AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    "hex": ("[0-9a-f]{16,}", 0, 16, ()),
}
MORE_KINDS = {
    "github": ("gh[pousr]_[A-Za-z0-9]{30,}", 0, 34, ("gh",)),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    "google": ("AIza[A-Za-z0-9_-]{30,}", 0, 34, ("AIza",)),
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+", 0, 20, ("eyJ",)),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+", 0, 60, ("PRIVATE KEY",)),
}
KINDS = BASE_KINDS | MORE_KINDS
_SPAN = "array<struct<at:int,ord:int,stop:int,kind:string,value:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _sums(numbers: Column) -> Column:
    """Running sums, in time that grows with the square of the numbers: for chunks."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<int>)").alias("out"))
    return F.aggregate(numbers, start, lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["out"], F.array(state["at"] + n)).alias("out")))["out"]


def _ends(numbers: Column) -> Column:
    """Running sums of any number of integers: within chunks, and over the chunks' totals, so that a text of very many
    spans isn't copied once for each of them."""

    def summed(n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / CHUNK).cast("int")), lambda i: _sums(F.slice(n, i * CHUNK + 1, F.lit(CHUNK))))
        return _bound(parts, lifted)

    def lifted(parts: Column) -> Column:
        total = lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))
        ends = _sums(F.transform(parts, total))
        return F.flatten(F.zip_with(parts, ends, lambda p, end: F.transform(p, lambda x: x + (end - total(p)))))

    return _bound(numbers, summed)


def _spans(text: Column, order: int, kind: str) -> Column:
    pattern, group, least, needed = KINDS[kind]
    lit = F.lit(pattern)
    gaps, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0)), F.regexp_extract_all(text, lit, F.lit(group))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("m"), value.alias("v"))
    none = F.expr(f"cast(array() AS {_SPAN})")

    def span(row: Column, stop: Column) -> Column:
        return F.struct((stop - F.length(row["m"])).alias("at"), F.lit(order).alias("ord"), stop.alias("stop"), F.lit(kind).alias("kind"), row["v"].alias("value"))

    placed = _bound(rows, lambda r: F.zip_with(r, _ends(F.transform(r, lambda x: F.length(x["g"]) + F.length(x["m"]))), span))
    found = F.filter(placed, lambda x: F.length(x["value"]) >= least).cast(_SPAN)
    if kind == "assign":
        low = F.lower(text)
        test = low.rlike("") if not needed else None
        for word in needed:
            test = low.contains(word) if test is None else test | low.contains(word)
    elif needed:
        test = text.contains(needed[0])
    else:
        test = text.rlike(pattern)
    return F.when(test, found).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with an array of (at, ord, stop, kind, value), by place and then by kind as listed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(spans, F.sort_array(F.concat(*[_spans(whole, i, k) for i, k in enumerate(KINDS)])))


def ownership(found: DataFrame, repo: str, owner: str, spans: str = "spans") -> DataFrame:
    """A row for each value's hash: n_repos, n_owners and live."""
    held = found.select(F.struct(repo).alias("r"), F.struct(owner).alias("o"), F.explode(spans).alias("s")).select(F.sha2("s.value", 256).alias("hash"), "r", "o")
    repos = held.select("hash", "r").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = held.select("hash", "o").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") == 2) & (F.col("n_repos") >= EXAMPLE_REPOS))
    return repos.join(owners, "hash").withColumn("live", ~example)


def labelled(found: DataFrame, repo: str, owner: str, key: str) -> DataFrame:
    """(key, spans with their verdict ``live``, counts) of the rows that have spans. found is a written table
    whose key is unique."""
    examples = ownership(found, repo, owner).filter("NOT live").select("hash", F.lit(True).alias("example"))
    each = found.select(key, F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    each = salted_join(each, examples, ["hash"], [key], "left").withColumn("live", F.col("example").isNull())
    return each.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("s.at", "s.ord", "s.stop", "s.kind", "live"))).alias("judged"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Counts by base kind, digest of the base spans, the base spans and the live ones of further kinds, and live and
    example counts of every row."""
    columns = dict.fromkeys([id_col, repo, owner])
    found = settled(with_spans(docs, text).select(*columns, "spans").withColumn("__row", F.monotonically_increasing_id()))
    marked = labelled(found, repo, owner, "__row")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return found.join(marked, "__row", "left").select(
        F.col(id_col),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        F.coalesce(_joined(F.filter("judged", lambda s: (s["ord"] < len(BASE_KINDS)) | s["live"])), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def redacted(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", mask: str = "[SECRET]", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with live spans replaced by the mask; examples and all other text stay."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text).alias("__text"), F.col(repo).alias("__repo"), F.col(owner).alias("__owner"))
    found = settled(with_spans(packed, "__text").withColumn("__row", F.monotonically_increasing_id()))
    live = labelled(found, "__repo", "__owner", "__row").filter("n_live > 0").select("__row", F.filter("judged", lambda s: s["live"]).alias("live_spans"))
    whole = F.col("__text")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, F.greatest(s["at"] - state["at"], F.lit(0)))
        return F.struct(
            F.when(s["at"] >= state["at"], F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
            F.greatest(s["stop"], state["at"]).alias("at"),
        )

    cut = F.aggregate("live_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole))))
    plain = found.filter(F.size("spans") == 0).select("__doc.*")
    rest = found.filter(F.size("spans") > 0).join(live, "__row", "left").withColumn("__new", F.when(F.col("live_spans").isNull(), whole).otherwise(cut))
    changed = {text: F.col("__new")}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("live_spans").isNull(), F.col(f"__doc.{n_chars}")).otherwise(F.length("__new").cast(docs.schema[n_chars].dataType))
    return plain.unionByName(rest.select(*[changed.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns]))
