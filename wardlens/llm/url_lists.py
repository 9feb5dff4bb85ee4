"""URL filters: as-of join of captures with dated list entries.

A list entry says that from a date on a host (with its subdomains) or a URL
prefix is listed under a category, or no longer is.  The entries of a pattern
become validity intervals ``[valid_from, valid_to)``; a capture is judged by
the intervals that hold its fetch date.

Intervals are cut at month borders and joined on (pattern, month) and the
date, so neither a pattern with very many entries nor one with a long life
makes every capture meet every entry; captures that agree in pattern keys and
date are joined once, so a host with a third of the captures is a few rows.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import bounded, cut, lower_ascii


def url_host(url: Column) -> Column:
    """The lower-cased host without user, port and last dot; empty for null or a URL without one."""
    authority = F.regexp_extract(lower_ascii(F.trim(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def url_path(url: Column) -> Column:
    """The path, from its slash up to ``?`` or ``#``; a slash if there is none."""
    path = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def pattern_keys(host: Column, path: Column) -> Column:
    """What entries can name a URL by: its host, every parent domain, and host with each leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, category, valid_from, valid_to`` (null: still valid) from dated entries ``pattern, category, listed_on, active``.

    Of several entries for a pattern and category on one day, a listing wins
    over a removal.  Entries without a pattern, category or date are left out;
    a null ``active`` is a removal.  Only changes of state start or end an interval.
    """
    day = entries.where(F.col("pattern").isNotNull() & F.col("category").isNotNull() & F.col("listed_on").isNotNull()).groupBy("pattern", "category", "listed_on").agg(
        F.max(F.coalesce("active", F.lit(False))).alias("active"))
    line = Window.partitionBy("pattern", "category").orderBy("listed_on")
    changes = day.withColumn("was", F.coalesce(F.lag("active").over(line), F.lit(False))).where("active <> was")
    spans = changes.withColumn("valid_to", F.lead("listed_on").over(line)).where("active")
    return spans.select("pattern", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def as_of_matches(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """Distinct ``keys, fetched_on`` of ``captures`` (``keys, fetched_on``) with the active ``categories`` and ``n_entries``."""
    cases = cut(captures.where(F.col("fetched_on").isNotNull() & (F.size("keys") > 0)).select("keys", "fetched_on").distinct(), "captures")
    span = cases.agg(F.min("fetched_on"), F.max("fetched_on")).first()  # two dates
    if span[0] is None:
        span = (None, None)
    first, last = F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")
    live = intervals.where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    months = F.sequence(F.trunc(F.greatest("valid_from", first), "month"), F.trunc(F.least(F.coalesce(F.date_sub("valid_to", 1), last), last), "month"), F.expr("interval 1 month"))
    lists = bounded(cut(live.withColumn("month", F.explode(months)), "intervals"))
    asked = cases.select("keys", "fetched_on", F.trunc("fetched_on", "month").alias("month"), F.explode("keys").alias("pattern"))
    held = asked.join(lists, ["pattern", "month"]).where((F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    return held.groupBy("keys", "fetched_on").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("n_entries"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge every capture by the entries active at its fetch date.

    ``captures``: any columns with ``url`` and ``fetched_on`` (date).  Adds
    ``host, n_entries, categories`` (sorted, comma-joined; empty if none),
    ``blocked``, a row per input row.  A null or odd URL has no host and, like
    a null date, no active entry.  Columns of these names in ``captures`` are
    replaced.
    """
    added = ("host", "n_entries", "categories", "blocked")
    base = captures.drop(*added)
    host = url_host(F.col("url"))
    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), host.alias("host"), pattern_keys(host, url_path(F.col("url"))).alias("keys"), F.col("fetched_on").alias("on"))
    found = bounded(cut(as_of_matches(rows.select("keys", F.col("on").alias("fetched_on")), validity_intervals(entries)), "active"))
    found = found.withColumnsRenamed({"keys": "k", "fetched_on": "f"})
    out = rows.join(found, (F.col("keys") == F.col("k")) & (F.col("on") == F.col("f")), "left")
    return out.select("row.*", "host", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"), F.col("categories").isNotNull().alias("blocked"))
