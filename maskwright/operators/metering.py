"""Keys, limits, quotas, usage and plans over tables of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.frames import bounded_broadcast, materialise
from maskwright.functions.ranks import join_by, quantile_cell, value_rank

#: The plan catalogue (id, name, rate a minute, monthly tokens (-1: no limit), most keys, price in cents).
PLANS = (
    ("free", "Free", 10, 1_000, 2, 0),
    ("starter", "Starter", 60, 50_000, 5, 1_900),
    ("business", "Business", 200, 500_000, 20, 7_900),
    ("enterprise", "Enterprise", 1_000, -1, 100, 0),
)
DEFAULT_PLAN = "free"
ADMIN_LIMIT = 10
OPS = ("tokenize", "rehydrate", "detect")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLANS), "plan_id string, name string, rate_limit_per_minute int, monthly_token_limit long, max_keys int, price_cents int")


def plan_of(orgs: DataFrame, assigned: DataFrame) -> DataFrame:
    """(org_id, plan columns): the last assigned plan (org_id, plan_id, assigned_at); free where there is
    none or it is not in the catalogue. The catalogue is four rows, so it is broadcast."""
    catalogue = plans(orgs.sparkSession)
    last = assigned.groupBy("org_id").agg(F.max_by("plan_id", F.struct("assigned_at", "plan_id")).alias("plan_id"))
    known = last.join(F.broadcast(catalogue.select("plan_id")), "plan_id", "left_semi")
    given = orgs.select("org_id").distinct().join(known, "org_id", "left").withColumn("plan_id", F.coalesce("plan_id", F.lit(DEFAULT_PLAN)))
    return given.join(F.broadcast(catalogue), "plan_id")


def authenticate(calls: DataFrame, keys: DataFrame, key_col: str = "api_key") -> DataFrame:
    """Add key_id, org_id and reason: null for an active key, ``invalid_key`` for a missing or revoked
    one, ``malformed_key`` for control characters."""
    live = keys.where("active").select("key_hash", "key_id", "org_id")
    hashed = calls.withColumn("_h", F.sha2(F.col(key_col).cast("binary"), 256))
    bad = F.col(key_col).rlike(r"[\x00-\x1F\x7F]")
    joined = hashed.join(live, (hashed["_h"] == live["key_hash"]) & ~bad, "left").drop("_h", "key_hash")
    return joined.withColumn("reason", F.when(bad, "malformed_key").when(F.col("key_id").isNull(), "invalid_key"))


def rate_limit(calls: DataFrame, limit, key: str = "key_id") -> DataFrame:
    """Add ``n`` (place of the call in its key's clock minute) and ``allowed``. Refused calls count too."""
    w = Window.partitionBy(key, F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    cap = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return calls.withColumn("n", F.row_number().over(w).cast("long")).withColumn("allowed", F.col("n") <= cap)


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The last entry of X-Forwarded-For, else the peer."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.when(F.length(last) > 0, last).otherwise(peer)


def running_quota(calls: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(event_id, org_id, month, used, admitted) of calls (org_id, ts, event_id, tokens, cap): a running total for
    each org and month, from those of ``used`` (org_id, month, used) on, that a refused call does not raise.

    Calls are sorted by Spark, which spills, and folded with one running number, so a task holds one
    Arrow batch whatever the group's size.
    """
    month = F.date_format("ts", "yyyy-MM").alias("month")
    keyed = calls.select("org_id", month, "ts", F.col("event_id").cast("long").alias("event_id"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.col("cap").cast("long").alias("cap"))
    if used is not None:
        keyed = join_by(keyed, bounded_broadcast(used.select("org_id", "month", F.col("used").alias("_from"))), ["org_id", "month"], "left")
    else:
        keyed = keyed.withColumn("_from", F.lit(None).cast("long"))
    ordered = keyed.repartition("org_id", "month").sortWithinPartitions("org_id", "month", "ts", "event_id").drop("ts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0
        for batch in batches:
            orgs, months, _, tokens, caps, start = (c.to_pylist() for c in batch.columns)
            sums, ok = [], []
            for org, at, n, limit, first in zip(orgs, months, tokens, caps, start, strict=True):
                if (org, at) != group:
                    group, total = (org, at), first or 0
                admitted = limit < 0 or total + n <= limit
                total += n if admitted else 0
                sums.append(total)
                ok.append(admitted)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(ok, pa.bool_())], ["event_id", "org_id", "month", "used", "admitted"])

    return ordered.mapInArrow(fold, f"event_id long, org_id {keyed.schema['org_id'].dataType.simpleString()}, month string, used long, admitted boolean")


def monthly_quota(calls: DataFrame, plan: DataFrame, by: str = "hour") -> DataFrame:
    """(event_id, org_id, month, used, admitted). A call whose tokens would exceed the month's limit is
    refused and does not count; a later smaller one may pass. Orgs without a limit admit all.

    Sums by clock hour and their running sums tell the call that first crosses the limit, without a task
    that holds an org: all calls before it pass. Behind it, a call with more tokens than were left then
    never passes, since what is left only shrinks, and one without tokens always does. Only the others, small
    calls behind the crossing, are folded one by one. The totals are running sums of what passed.
    """
    limit = F.coalesce("monthly_token_limit", F.lit(PLANS[0][3]).cast("long"))
    plans = bounded_broadcast(plan.select("org_id", F.col("monthly_token_limit").cast("long").alias("monthly_token_limit")))
    key = ["org_id", "month"]
    rows = join_by(calls.select("org_id", "ts", F.col("event_id").cast("long").alias("event_id"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), plans, ["org_id"], "left")
    rows = materialise(rows.select("org_id", F.date_format("ts", "yyyy-MM").alias("month"), F.date_trunc(by, "ts").alias("_cell"), "ts", "event_id", "tokens", limit.alias("cap")))
    sums = _running(rows, key, F.col("tokens"), "_upto")
    crossing = sums.where((F.col("cap") >= 0) & (F.col("_upto") > F.col("cap"))).groupBy(*key).agg(F.min(F.struct("ts", "event_id", (F.col("_upto") - F.col("tokens")).alias("before"))).alias("x"))
    met = join_by(rows, bounded_broadcast(crossing.select(*key, "x")), key, "left")
    behind = F.col("x").isNotNull() & (F.struct("ts", "event_id") >= F.struct("x.ts", "x.event_id"))
    small = F.col("tokens").between(1, F.col("cap") - F.col("x.before"))
    marked = materialise(met.withColumn("_fold", behind & small).withColumn("admitted", ~behind | (F.col("tokens") == 0)).withColumn("before", F.col("x.before")).drop("x"))
    rest = marked.where("_fold")
    start = rest.groupBy(*key).agg(F.first("before").alias("used"))
    folded = join_by(rest.drop("admitted"), running_quota(rest, start).select("event_id", *key, "admitted"), ["event_id", *key])
    columns = [*key, "_cell", "ts", "event_id", "tokens", "admitted"]
    every = marked.where("not _fold").select(*columns).unionByName(folded.select(*columns))
    return _running(every, key, F.when(F.col("admitted"), F.col("tokens")).otherwise(F.lit(0)), "used").select("event_id", *key, "used", "admitted")


def _running(rows: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the running sum of ``value`` in a group by (ts, event_id), from sums by ``_cell``."""
    valued = rows.withColumn("_v", value)
    cells = valued.groupBy(*by, "_cell").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*by, "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy(*by, "_cell").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return join_by(valued, cells, [*by, "_cell"]).withColumn(out, F.col("_before") + own).drop("_v", "_before")


def usage_monthly(calls: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """(org_id, month, n_tokenize, n_rehydrate, n_detect, tokens); with ``orgs``, those without calls
    appear once with a null month and zeros."""
    counts = calls.groupBy("org_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        *(F.sum((F.col("op") == o).cast("long")).alias(f"n_{o}") for o in OPS), F.sum("tokens").alias("tokens")
    )
    if orgs is None:
        return counts
    return orgs.select("org_id").distinct().join(counts, "org_id", "left").na.fill(0, [f"n_{o}" for o in OPS] + ["tokens"])


def usage_report(usage: DataFrame, plan: DataFrame, compat: bool = False) -> DataFrame:
    """Usage rows with plan, limit, what is left and the share used in percent. All tokens are counted;
    with ``compat`` those of plans without a limit read 0."""
    joined = usage.join(plan.select("org_id", F.col("name").alias("plan_name"), "monthly_token_limit"), "org_id")
    free = F.col("monthly_token_limit") < 0
    if compat:
        joined = joined.withColumn("tokens", F.when(free, F.lit(0)).otherwise(F.col("tokens")))
    return joined.select(
        *usage.columns,
        "plan_name",
        "monthly_token_limit",
        F.when(free, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.col("monthly_token_limit") - F.col("tokens"))).alias("remaining"),
        F.when(free, F.lit(0.0)).otherwise(F.round(F.col("tokens") * 100.0 / F.col("monthly_token_limit"), 2)).alias("percent"),
    )


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at rank max(1, ceil(p / 100 * n)) of each group.

    A group's values are counted (a partial aggregate) in cells of about as many distinct values each; running sums over the cells tell which cell holds a rank, and only
    distinct values of such cells are put in order. So no task sorts a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    edges = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    celled = quantile_cell(join_by(counts, edges, by), by, "_v")
    w = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = celled.groupBy(*by, "_n", "_c").agg(F.sum("_k").alias("_s")).withColumn("_upto", F.sum("_s").over(w))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(p) / 100 * F.col("_n"))).alias("rank")) for name, p in percents.items())))
    holds = (F.col("x.rank") <= F.col("_upto")) & (F.col("x.rank") > F.col("_upto") - F.col("_s"))
    wanted = sums.select(*by, "_c", "_s", "_upto", asked.alias("x")).where(holds)
    wanted = wanted.select(*by, "_c", F.col("x.name").alias("_name"), (F.col("x.rank") - (F.col("_upto") - F.col("_s"))).alias("_left"))
    inside = join_by(celled, wanted.select(*by, "_c").distinct(), [*by, "_c"], "left_semi")
    ordered = inside.select(*by, "_c", "_v", F.sum("_k").over(Window.partitionBy(*by, "_c").orderBy("_v")).alias("_cum"))
    found = join_by(ordered, wanted, [*by, "_c"]).where(F.col("_cum") >= F.col("_left")).groupBy(*by, "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in percents))


def usage_daily(calls: DataFrame) -> DataFrame:
    """(org_id, day, calls by operation, tokens, p50 and p95 of detection time)."""
    day = calls.withColumn("day", F.to_date("ts"))
    counts = day.groupBy("org_id", "day").agg(*(F.sum((F.col("op") == o).cast("long")).alias(f"n_{o}") for o in OPS), F.sum("tokens").alias("tokens"))
    times = nearest_rank(day.where("op = 'detect'"), ["org_id", "day"], "duration_ms", {"p50": 50, "p95": 95})
    return join_by(counts, times, ["org_id", "day"], "left")


def usage_period(daily: DataFrame, plan: DataFrame, asof: str, days: int) -> DataFrame:
    """Totals of the ``days`` days up to ``asof`` by org, and the month's share of the plan, at most 100."""
    last = F.to_date(F.lit(asof))
    window = daily.where(F.col("day").between(F.date_sub(last, days - 1), last))
    totals = window.groupBy("org_id").agg(*(F.sum(f"n_{o}").alias(f"n_{o}") for o in OPS), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_days"))
    month = daily.where(F.date_format("day", "yyyy-MM") == F.date_format(last, "yyyy-MM")).groupBy("org_id").agg(F.sum("tokens").alias("month_tokens"))
    joined = totals.join(month, "org_id", "left").join(plan.select("org_id", "monthly_token_limit"), "org_id", "left")
    share = F.when(F.col("monthly_token_limit") > 0, F.least(F.lit(100.0), F.round(F.col("month_tokens") * 100.0 / F.col("monthly_token_limit"), 2))).otherwise(F.lit(0.0))
    return joined.select("org_id", *(f"n_{o}" for o in OPS), "tokens", "n_days", share.alias("month_percent"))


def usage_percent(daily: DataFrame, plan: DataFrame, month_start: str) -> DataFrame:
    """(org_id, month_tokens, percent): tokens from ``month_start`` on, and their whole percent of the plan's
    limit, 100 at most; 0 without a limit."""
    spent = daily.where(F.col("day") >= F.lit(month_start).cast("date")).groupBy("org_id").agg(F.sum("tokens").alias("month_tokens"))
    joined = join_by(plan.select("org_id", "monthly_token_limit"), spent, ["org_id"], "left").withColumn("month_tokens", F.coalesce("month_tokens", F.lit(0)))
    whole = F.floor(F.col("month_tokens") / F.col("monthly_token_limit") * 100 + 0.5)
    return joined.select("org_id", "month_tokens", F.when(F.col("monthly_token_limit") > 0, F.least(F.lit(100), whole)).otherwise(0).cast("int").alias("percent"))


def usage_cards(daily: DataFrame) -> DataFrame:
    return daily.groupBy("org_id").agg(F.sum(sum((F.col(f"n_{o}") for o in OPS), F.lit(0))).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.avg("p95"), 2).alias("mean_p95"))


def active_key_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("org_id").agg(F.sum(F.col("active").cast("long")).alias("n_active"), F.count(F.lit(1)).alias("n_keys"))


def admit_new_keys(requests: DataFrame, keys: DataFrame, plan: DataFrame) -> DataFrame:
    """Requests (org_id, request_no) with ``admitted`` while the org has fewer active keys than its plan
    allows. They are ranked in cells of an org, so no task orders all of its requests."""
    held = active_key_counts(keys).select("org_id", "n_active")
    placed = value_rank(requests, ["org_id"], F.col("request_no"), "request_no", out="_place")
    joined = placed.join(held, "org_id", "left").join(plan.select("org_id", "max_keys", "rate_limit_per_minute"), "org_id")
    total = F.coalesce("n_active", F.lit(0)) + F.col("_place")
    return joined.select("org_id", "request_no", (total <= F.col("max_keys")).alias("admitted"), "rate_limit_per_minute")


def revoke_keys(keys: DataFrame, revoked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys with the revoked ones inactive, each revoked key_id with ``found``)."""
    asked = revoked.select("key_id").distinct().withColumn("_gone", F.lit(True))
    after = keys.join(asked, "key_id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")
    return after, asked.join(keys.select("key_id", F.lit(True).alias("_known")).distinct(), "key_id", "left").select("key_id", F.coalesce("_known", F.lit(False)).alias("found"))


def assign_plans(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """The last wanted plan of each org with ``reason``: unknown_plan, too_many_keys or null (assigned)."""
    last = wanted.groupBy("org_id").agg(F.max_by("plan_id", F.struct("assigned_at", "plan_id")).alias("plan_id"))
    joined = last.join(F.broadcast(plans(wanted.sparkSession).select("plan_id", "max_keys")), "plan_id", "left").join(active_key_counts(keys).select("org_id", "n_active"), "org_id", "left")
    reason = F.when(F.col("max_keys").isNull(), "unknown_plan").when(F.coalesce("n_active", F.lit(0)) > F.col("max_keys"), "too_many_keys")
    return joined.select("org_id", "plan_id", reason.alias("reason"))


def org_summary(plan: DataFrame, usage: DataFrame, keys: DataFrame, month: str) -> DataFrame:
    """Plan, tokens of a month and active keys of each org."""
    now = usage.where(F.col("month") == month).select("org_id", "tokens")
    joined = plan.select("org_id", "plan_id").join(now, "org_id", "left").join(active_key_counts(keys), "org_id", "left")
    return joined.select("org_id", "plan_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_active", F.lit(0)).alias("n_active"))
