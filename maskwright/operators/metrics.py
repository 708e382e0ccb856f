"""Counters, histograms and audit roll-ups over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.ranks import join_by, value_rank
from maskwright.operators.metering import nearest_rank

#: Histogram bounds in milliseconds and the samples a summary looks back on.
BUCKETS = (10, 25, 50, 100, 250, 500, 1000)
LAST_SAMPLES = 10_000


def counters(events: DataFrame) -> DataFrame:
    """Counts by name and by name and label; a total has a null label."""
    return events.groupingSets([["name"], ["name", "label"]], "name", "label").agg(F.count(F.lit(1)).alias("n"))


def label_key(labels: Column) -> Column:
    """``k=v`` pairs sorted by key and joined by commas, ``all`` where there are none."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.array_join(pairs, ",")).otherwise("all")


def recent(events: DataFrame, by: list[str], last: int = LAST_SAMPLES) -> DataFrame:
    """The ``last`` newest rows of each group; no task orders a whole group but for rows of one instant."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return value_rank(events, by, micros, "event_id", descending=True, out="_n").where(F.col("_n") <= last).select(*events.columns)


def histogram_summary(events: DataFrame, by: list[str], last: int = LAST_SAMPLES) -> DataFrame:
    """count, sum, min, max, nearest-rank p50 and p99 of the most recent samples, three decimals."""
    rows = recent(events, by, last)
    stats = rows.groupBy(*by).agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.min("value"), 3).alias("low"), F.round(F.max("value"), 3).alias("high"))
    ranks = nearest_rank(rows, by, "value", {"p50": 50, "p99": 99})
    return join_by(stats, ranks, by, "left").withColumns({c: F.round(c, 3) for c in ("p50", "p99")})


def histogram_buckets(events: DataFrame, bounds: tuple[int, ...] = BUCKETS, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """Cumulative counts (``by``, le, n) with count and sum of each series: a name, or a name and its label."""
    sums = [F.sum((F.col("value") <= b).cast("long")).alias(f"_{b}") for b in bounds]
    wide = events.groupBy(*by).agg(*sums, F.count("value").alias("count"), F.round(F.sum("value"), 3).alias("sum"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_{b}").alias("n")) for b in bounds] + [F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n"))]
    return wide.select(*by, F.explode(F.array(*rows)).alias("b"), "count", "sum").select(*by, "b.le", "b.n", "count", "sum")


def exposition_lines(buckets: DataFrame, prefix: str = "app") -> DataFrame:
    """Prometheus text rows (line) of histogram buckets, counts and sums; a ``label`` column ("key=value,..." or
    "all" for a series without one) is written into the braces."""
    pairs = F.array_join(F.transform(F.split("label", ","), lambda x: F.regexp_replace(x, "^([^=]*)=(.*)$", '$1="$2"')), ",")
    own = F.when(F.col("label").isNull() | F.col("label").isin("all", ""), "").otherwise(pairs) if "label" in buckets.columns else F.lit("")
    rows = buckets.withColumn("_own", own)
    both = F.concat("_own", F.when(F.col("_own") == "", "").otherwise(","))
    line = rows.select(F.format_string(f'{prefix}_%s_bucket{{%sle="%s"}} %d', "name", both, "le", "n").alias("line"))
    braces = F.when(F.col("_own") == "", "").otherwise(F.concat(F.lit("{"), F.col("_own"), F.lit("}")))
    once = rows.where(F.col("le") == "+Inf").select("name", braces.alias("at"), "count", F.coalesce("sum", F.lit(0.0)).alias("sum"))
    ends = F.array(F.format_string(f"{prefix}_%s_count%s %d", "name", "at", "count"), F.format_string(f"{prefix}_%s_sum%s %.3f", "name", "at", "sum"))
    return line.unionByName(once.select(F.explode(ends).alias("line")))


def org_pseudonym(org: Column) -> Column:
    return F.substring(F.sha2(org.cast("string").cast("binary"), 256), 1, 12)


def audit_rollup(calls: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(org, operation): calls, tokens, time in ms; the org is a pseudonym. With ``found``, rows (event_id,
    pii_type) of what the calls detected, also ``type_counts``, a map of counts by type, empty where nothing was."""
    named = calls.select(org_pseudonym(F.col("org_id")).alias("org"), F.col("op").alias("operation"), "event_id", "tokens", "duration_ms")
    key = ["org", "operation"]
    sums = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"))
    if found is None:
        return sums
    each = found.groupBy("event_id", "pii_type").agg(F.count(F.lit(1)).alias("k"))  # before the join
    typed = named.select("event_id", *key).join(each, "event_id").groupBy(*key, "pii_type").agg(F.sum("k").alias("k"))
    maps = typed.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "k")))).alias("type_counts"))
    return join_by(sums, maps, key, "left").withColumn("type_counts", F.coalesce("type_counts", F.create_map().cast("map<string,bigint>")))


def reject_fields(events: DataFrame, allowed: tuple[str, ...], col: str = "fields") -> DataFrame:
    """Add ``extra``: the names of a map column that are not on the list, sorted."""
    return events.withColumn("extra", F.array_sort(F.array_except(F.map_keys(col), F.array(*map(F.lit, allowed)))))
