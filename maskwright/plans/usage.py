"""Queries of limits, usage, plans, metrics and audit. Calls are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import metering as M
from maskwright.operators import metrics as K
from maskwright.plans.registry import Tables, derive, query, select

CALL = {
    "event_id": "event_id",
    "ts": "ts",
    "key_id": "user_id",
    "org_id": "user_id % 20",
    "op": "case event_type when 'view' then 'tokenize' when 'click' then 'detect' when 'purchase' then 'rehydrate' else 'other' end",
    "tokens": "cast(floor(value) as bigint)",
    "duration_ms": "value",
}
CALLS = f"calls as ({select(CALL, 'events')})"
#: One key for each user: the newest event of a user decides whether it is active.
KEY = {"key_id": "user_id", "org_id": "user_id % 20", "active": "max(event_id) % 7 <> 0"}
KEYS = "keys as (select user_id as key_id, user_id % 20 as org_id, max(event_id) % 7 <> 0 as active from events group by user_id)"
#: Orgs ask for plans; some ask for one that is not in the catalogue.
WISH = {
    "org_id": "user_id % 20",
    "assigned_at": "ts",
    "plan_id": "case cast(floor(value) as bigint) % 5 when 0 then 'free' when 1 then 'starter' when 2 then 'business' when 3 then 'enterprise' else 'gold' end",
}
WISHES = f"wishes as ({select(WISH, 'events')})"
PLAN_ROWS = "catalogue(plan_id, name, rate, cap, max_keys, price) as (values " + ", ".join(f"('{a}', '{b}', {c}, {d}, {e}, {f})" for a, b, c, d, e, f in M.PLANS) + ")"
PLAN = f"""{WISHES}, {PLAN_ROWS},
last_wish as (select org_id, max_by(plan_id, (assigned_at, plan_id)) as wish from wishes group by org_id),
plan as (select o.org_id, c.* from (select distinct user_id % 20 as org_id from events) o left join last_wish w on o.org_id = w.org_id
  join catalogue c on c.plan_id = case when w.wish in (select plan_id from catalogue) then w.wish else 'free' end)"""
COUNTS = ", ".join(f"cast(count(*) filter (op = '{o}') as bigint) as n_{o}" for o in M.OPS) + ", cast(sum(tokens) as bigint) as tokens"
USAGE = f"usage as (select org_id, strftime(ts, '%Y-%m') as month, {COUNTS} from calls group by 1, 2)"
RANK = "max(case when r = greatest(1, cast(ceil({p} / 100.0 * n) as bigint)) then {v} end)"


def rank(p: int, v: str) -> str:
    return RANK.format(p=p, v=v)


DAILY = f"""counted as (select org_id, cast(ts as date) as day, {COUNTS} from calls group by 1, 2),
times as (select org_id, day, {rank(50, 'd')} as p50, {rank(95, 'd')} as p95 from (select org_id, cast(ts as date) as day, duration_ms as d,
    row_number() over (partition by org_id, cast(ts as date) order by duration_ms) as r, count(*) over (partition by org_id, cast(ts as date)) as n
  from calls where op = 'detect') group by 1, 2),
daily as (select counted.*, p50, p95 from counted left join times using (org_id, day))"""


def calls(t: Tables):
    return derive(t.events, CALL)


def keys(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("key_id"), (F.col("user_id") % 20).alias("org_id")).agg((F.max("event_id") % 7 != 0).alias("active"))


def wishes(t: Tables):
    return derive(t.events, WISH)


def plan(t: Tables):
    return M.plan_of(calls(t), wishes(t))


@query(f"""with {KEYS}, k as (select *, sha256('key-' || key_id) as h from keys), c as (select event_id, 'key-' || (user_id + case when event_id % 11 = 0 then 100000 else 0 end) || case when event_id % 13 = 0 then chr(7) else '' end as api_key from events)
select c.event_id, case when event_id % 13 = 0 then null else k.key_id end as key_id, case when event_id % 13 = 0 then null else k.org_id end as org_id,
  case when event_id % 13 = 0 then 'malformed_key' when k.key_id is null then 'invalid_key' end as reason from c left join k on sha256(api_key) = h and active""")
def authenticate_calls(t: Tables):
    shown = F.concat(F.lit("key-"), (F.col("user_id") + F.when(F.col("event_id") % 11 == 0, 100000).otherwise(0)).cast("string"), F.when(F.col("event_id") % 13 == 0, "\x07").otherwise(""))
    own = keys(t).withColumn("key_hash", F.sha2(F.concat(F.lit("key-"), F.col("key_id").cast("string")).cast("binary"), 256))
    return M.authenticate(t.events.select("event_id", shown.alias("api_key")), own).select("event_id", "key_id", "org_id", "reason")


_LIMIT = "with {calls} select event_id, {key} as key_id, n, n <= {limit} as allowed from (select *, row_number() over (partition by {key}, date_trunc('minute', ts) order by ts, event_id) as n from calls)"


@query(_LIMIT.format(calls=CALLS, key="org_id", limit=1))
def rate_limit(t: Tables):
    out = M.rate_limit(calls(t), 1, "org_id")
    return out.select("event_id", F.col("org_id").alias("key_id"), "n", "allowed")


@query(
    """with c as (select event_id, ts, '10.0.' || (user_id % 3) || '.1' as ip from events)
select event_id, ip, n, n <= 10 as allowed from (select *, row_number() over (partition by ip, date_trunc('hour', ts) order by ts, event_id) as n from c)"""
)
def admin_rate_limit(t: Tables):
    xff = F.concat(F.lit("1.2.3.4, 10.0."), (F.col("user_id") % 3).cast("string"), F.lit(".1"))
    rows = t.events.select("event_id", F.date_trunc("hour", "ts").alias("ts"), M.client_ip(xff, F.lit("127.0.0.1")).alias("ip"))
    return M.rate_limit(rows, M.ADMIN_LIMIT, "ip").select("event_id", "ip", "n", "allowed")


@query(f"""with {CALLS}, {PLAN},
g as (select c.org_id, strftime(ts, '%Y-%m') as month, max(cap) as cap, list({{'event_id': event_id, 'tokens': tokens}} order by ts, event_id) as l from calls c join plan using (org_id) group by 1, 2),
f as (select org_id, month, list_reduce(l, lambda a, x: {{'used': case when a.cap < 0 or a.used + x.tokens <= a.cap then a.used + x.tokens else a.used end, 'cap': a.cap,
    'out': list_append(a.out, {{'event_id': x.event_id, 'used': case when a.cap < 0 or a.used + x.tokens <= a.cap then a.used + x.tokens else a.used end, 'admitted': a.cap < 0 or a.used + x.tokens <= a.cap}})}},
  {{'used': cast(0 as bigint), 'cap': cast(cap as bigint), 'out': cast([] as struct(event_id bigint, used bigint, admitted boolean)[])}}).out as o from g),
u as (select org_id, month, unnest(o) as x from f)
select x.event_id as event_id, org_id, month, x.used as used, x.admitted as admitted from u""")
def monthly_quota(t: Tables):
    return M.monthly_quota(calls(t), plan(t))


@query(f"with {CALLS}, {USAGE} select * from usage")
def usage_monthly(t: Tables):
    return M.usage_monthly(calls(t))


_REPORT = f"""with {CALLS}, {PLAN}, {USAGE} select u.*, p.name as plan_name, cast(p.cap as bigint) as monthly_token_limit,
  cast(case when cap < 0 then -1 else greatest(0, cap - tokens) end as bigint) as remaining, case when cap < 0 then 0.0 else round(tokens * 100.0 / cap, 2) end as percent
  from usage u join plan p using (org_id)"""


@query(_REPORT)
def usage_report(t: Tables):
    return M.usage_report(M.usage_monthly(calls(t)), plan(t))


@query(f"select * replace (case when monthly_token_limit < 0 then 0 else tokens end as tokens) from ({_REPORT})")
def usage_report_compat(t: Tables):
    return M.usage_report(M.usage_monthly(calls(t)), plan(t), compat=True)


@query(f"with {CALLS}, {DAILY} select * from daily")
def usage_daily(t: Tables):
    return M.usage_daily(calls(t))


@query(f"""with {CALLS}, {PLAN}, {DAILY}, w as (select org_id, {", ".join(f"cast(sum(n_{o}) as bigint) as n_{o}" for o in M.OPS)}, cast(sum(tokens) as bigint) as tokens, count(*) as n_days
  from daily where day between date '2024-01-15' and date '2024-01-21' group by org_id),
m as (select org_id, sum(tokens) as month_tokens from daily where strftime(day, '%Y-%m') = '2024-01' group by org_id)
select w.*, case when cap > 0 then least(100.0, round(month_tokens * 100.0 / cap, 2)) else 0.0 end as month_percent from w left join m using (org_id) left join plan using (org_id)""")
def usage_period(t: Tables):
    return M.usage_period(M.usage_daily(calls(t)), plan(t), "2024-01-21", 7).select("org_id", *(f"n_{o}" for o in M.OPS), "tokens", "n_days", "month_percent")


@query(f"with {CALLS}, {DAILY} select org_id, cast(sum(n_tokenize + n_rehydrate + n_detect) as bigint) as calls, cast(sum(tokens) as bigint) as tokens, round(avg(p95), 2) as mean_p95 from daily group by org_id")
def usage_cards(t: Tables):
    return M.usage_cards(M.usage_daily(calls(t)))


@query(
    f"""with {CALLS}, {DAILY}, {PLAN}, s as (select org_id, sum(tokens) as m from daily where day >= date '2024-01-15' group by 1)
select org_id, cast(coalesce(m, 0) as bigint) as month_tokens, cast(case when cap > 0 then least(100, floor(coalesce(m, 0) / cap * 100 + 0.5)) else 0 end as integer) as percent from plan left join s using (org_id)"""
)
def usage_cards_percent(t: Tables):
    return M.usage_percent(M.usage_daily(calls(t)), plan(t), "2024-01-15")


@query(f"with {PLAN} select org_id, plan_id, cast(rate as integer) as rate_limit_per_minute, cast(cap as bigint) as monthly_token_limit, cast(max_keys as integer) as max_keys, cast(price as integer) as price_cents from plan")
def plan_catalog(t: Tables):
    return plan(t).select("org_id", "plan_id", "rate_limit_per_minute", "monthly_token_limit", "max_keys", "price_cents")


@query(f"with {KEYS} select org_id, cast(sum(active::int) as bigint) as n_active, count(*) as n_keys from keys group by org_id")
def active_key_counts(t: Tables):
    return M.active_key_counts(keys(t))


@query(f"with {KEYS} select key_id, org_id, active from keys where org_id = 3")
def list_keys(t: Tables):
    return keys(t).where("org_id = 3")


@query(f"""with {KEYS}, {PLAN}, r as (select user_id % 20 as org_id, event_id as request_no from events where event_type = 'signup'),
a as (select org_id, sum(active::int) as n from keys group by org_id)
select r.org_id, request_no, coalesce(n, 0) + row_number() over (partition by r.org_id order by request_no) <= max_keys as admitted, cast(rate as integer) as rate_limit_per_minute
from r left join a using (org_id) join plan using (org_id)""")
def admit_new_keys(t: Tables):
    asked = t.events.where("event_type = 'signup'").select((F.col("user_id") % 20).alias("org_id"), F.col("event_id").alias("request_no"))
    return M.admit_new_keys(asked, keys(t), plan(t))


@query(f"with {KEYS}, r as (select distinct user_id + 75 as key_id from events where event_type = 'error') select k.key_id, org_id, active and r.key_id is null as active from keys k left join r using (key_id)")
def revoke_keys(t: Tables):
    gone = t.events.where("event_type = 'error'").select((F.col("user_id") + 75).alias("key_id"))
    return M.revoke_keys(keys(t), gone)[0].select("key_id", "org_id", "active")


@query(f"with {KEYS}, r as (select distinct user_id + 75 as key_id from events where event_type = 'error') select key_id, key_id in (select key_id from keys) as found from r", "revoked_found")
def _revoked(t: Tables):
    gone = t.events.where("event_type = 'error'").select((F.col("user_id") + 75).alias("key_id"))
    return M.revoke_keys(keys(t), gone)[1]


@query(f"""with {KEYS}, {WISHES}, {PLAN_ROWS}, l as (select org_id, max_by(plan_id, (assigned_at, plan_id)) as plan_id from wishes group by org_id), a as (select org_id, sum(active::int) as n from keys group by org_id)
select l.org_id, l.plan_id, case when c.max_keys is null then 'unknown_plan' when coalesce(n, 0) > c.max_keys then 'too_many_keys' end as reason
from l left join catalogue c using (plan_id) left join a using (org_id)""")
def assign_plans(t: Tables):
    return M.assign_plans(wishes(t), keys(t))


@query(f"""with {CALLS}, {KEYS}, {PLAN}, {USAGE}, a as (select org_id, sum(active::int) as n from keys group by org_id)
select p.org_id, plan_id, cast(coalesce(tokens, 0) as bigint) as tokens, cast(coalesce(n, 0) as bigint) as n_active from plan p left join (select * from usage where month = '2024-01') u using (org_id) left join a using (org_id)""")
def org_plan_summary(t: Tables):
    return M.org_summary(plan(t), M.usage_monthly(calls(t)), keys(t), "2024-01")


METRIC = {"event_id": "event_id", "ts": "ts", "name": "event_type", "label": "concat('user=', cast(user_id % 5 as string))", "value": "value"}
METRICS = f"m as ({select(METRIC, 'events')})"


def metric(t: Tables):
    return derive(t.events, METRIC)


@query(f"with {METRICS} select name, label, count(*) as n from m group by grouping sets ((name), (name, label))")
def counters(t: Tables):
    return K.counters(metric(t))


@query("select event_id, case when event_id % 3 = 0 then 'all' else 'k=' || json_extract_string(props, '$.k') || ',type=' || event_type end as key from events")
def label_key(t: Tables):
    pair = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return t.events.select("event_id", K.label_key(F.when(F.col("event_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(pair)).alias("key"))


def _summary(by: str, last: int) -> str:
    return f"""with {METRICS}, r as (select *, row_number() over (partition by {by} order by ts desc, event_id desc) as k from m),
x as (select *, row_number() over (partition by {by} order by value) as r, count(*) over (partition by {by}) as n from r where k <= {last})
select {by}, count(*) as n, round(sum(value), 3) as total, round(min(value), 3) as low, round(max(value), 3) as high, round({rank(50, "value")}, 3) as p50, round({rank(99, "value")}, 3) as p99 from x group by {by}"""


@query(_summary("name", 1500))
def histogram_summary(t: Tables):
    return K.histogram_summary(metric(t), ["name"], 1500)


@query(_summary("name, label", K.LAST_SAMPLES))
def histogram_summary_by_label(t: Tables):
    return K.histogram_summary(metric(t), ["name", "label"])


_BUCKETS = (
    f"with {METRICS}, b as (select name, count(value) as count, round(sum(value), 3) as sum, list(value) as l from m group by name) select name, le, case when le = '+Inf' then count else len(list_filter(l, lambda x: x <= try_cast(le as double))) end as n, count, sum from b, (select unnest(["
    + ", ".join(f"'{b}'" for b in K.BUCKETS)
    + ", '+Inf']) as le)"
)


@query(_BUCKETS)
def histogram_buckets(t: Tables):
    return K.histogram_buckets(metric(t))


def _lines(buckets: str, own: str) -> str:
    """Exposition lines of buckets; ``own`` is a series' labels in the text format, or ''."""
    return f"""with h as (select *, {own} as own from ({buckets})), o as (select *, case when own = '' then '' else '{{' || own || '}}' end as braces from h where le = '+Inf')
select 'app_' || name || '_bucket{{' || own || case when own = '' then '' else ',' end || 'le="' || le || '"}} ' || n as line from h
union all select 'app_' || name || '_count' || braces || ' ' || count from o union all select 'app_' || name || '_sum' || braces || ' ' || printf('%.3f', sum) from o"""


@query(_lines(_BUCKETS, "''"))
def exposition_lines(t: Tables):
    return K.exposition_lines(K.histogram_buckets(metric(t)))


_LABELLED = _BUCKETS.replace("select name, count(value)", "select name, label, count(value)").replace("group by name)", "group by name, label)").replace(") select name, le,", ") select name, label, le,")


@query(_lines(_LABELLED, "'user=\"' || split_part(label, '=', 2) || '\"'"))
def exposition_lines_by_label(t: Tables):
    return K.exposition_lines(K.histogram_buckets(metric(t), by=("name", "label")))


@query(f"with {CALLS} select substr(sha256(cast(org_id as varchar)), 1, 12) as org, op as operation, count(*) as n, cast(sum(tokens) as bigint) as tokens, round(sum(duration_ms), 3) as duration_ms from calls group by 1, 2")
def audit_rollup(t: Tables):
    return K.audit_rollup(calls(t))


_FOUND = "case when event_id % 5 = 0 then [] when event_id % 3 = 0 then ['em', 'pe', 'em'] when event_id % 3 = 1 then ['tel'] else ['pe', 'dt'] end"


@query(
    f"""with {CALLS}, f as (select event_id, unnest({_FOUND}) as pii_type from events), c as (select substr(sha256(cast(org_id as varchar)), 1, 12) as org, op as operation, * from calls),
t as (select org, operation, string_agg(pii_type || '=' || k, ',' order by pii_type) as type_counts from (select org, operation, pii_type, count(*) as k from c join f using (event_id) group by all) group by all),
s as (select org, operation, count(*) as n, cast(sum(tokens) as bigint) as tokens, round(sum(duration_ms), 3) as duration_ms from c group by all)
select s.*, coalesce(type_counts, '') as type_counts from s left join t using (org, operation)"""
)
def audit_rollup_types(t: Tables):
    e = F.col("event_id")
    many = F.when(e % 5 == 0, F.array().cast("array<string>")).when(e % 3 == 0, F.array(*map(F.lit, ("em", "pe", "em")))).when(e % 3 == 1, F.array(F.lit("tel"))).otherwise(F.array(F.lit("pe"), F.lit("dt")))
    found = t.events.select("event_id", F.explode_outer(many).alias("pii_type")).where("pii_type is not null")
    counts = F.array_join(F.transform(F.map_entries("type_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return K.audit_rollup(calls(t), found).withColumn("type_counts", counts)


@query("select event_id, case when event_id % 4 = 0 then 'email' else '' end as extra from events")
def allowlist_fields(t: Tables):
    fields = F.create_map(F.lit("op"), F.col("event_type"), F.when(F.col("event_id") % 4 == 0, "email").otherwise("org"), F.col("user_id").cast("string"))
    return K.reject_fields(t.events.select("event_id", fields.alias("fields")), ("op", "org")).select("event_id", F.array_join("extra", ",").alias("extra"))
