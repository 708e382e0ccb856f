"""Queries of template expansion and of streaming. Ids and slot values come from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import expand as X
from maskwright.operators import tokens as T
from maskwright.plans import detection as DT
from maskwright.plans import usage as U
from maskwright.plans.detection import _DEK
from maskwright.plans.registry import ORACLES, Tables, derive, query, select
from maskwright.streaming import jobs as J

_VALUES = "vals as (select 'pe' as slot, c_custkey as v, c_name as value from customer union all select 'org', s_suppkey, s_name from supplier union all select 'ind', o_orderkey, concat('Via Roma ', cast(o_custkey as varchar)) from orders)"


def values(t: Tables):
    pe = t.customer.select(F.lit("pe").alias("slot"), F.col("c_custkey").alias("v"), F.col("c_name").alias("value"))
    org = t.supplier.select(F.lit("org").alias("slot"), F.col("s_suppkey").alias("v"), F.col("s_name").alias("value"))
    ind = t.orders.select(F.lit("ind").alias("slot"), F.col("o_orderkey").alias("v"), F.concat(F.lit("Via Roma "), F.col("o_custkey").cast("string")).alias("value"))
    return pe.unionByName(org).unionByName(ind)


def _pick(id_: str, salt: str, n: str) -> str:
    return f"(cast('0x' || substr(md5({salt} || ':' || {id_}), 1, 8) as bigint) % {n})"


def _expand_sql(rows: tuple) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {q(f)}, [{', '.join(map(q, p))}], [{', '.join(map(q, s))}])" for i, (f, p, s) in enumerate(rows))
    return f"""with {_VALUES}, sizes as (select slot, count(*) as k from vals group by slot), tpl(t, family, parts, slots) as (values {table}),
c as (select doc_id as id, tpl.* from documents join tpl on tpl.t = {_pick("doc_id", "'42:t'", str(len(rows)))}),
s as (select id, unnest(slots) as slot, generate_subscripts(slots, 1) - 1 as i from c),
f as (select s.id, s.i, value, s.slot from s join sizes using (slot) join vals on vals.slot = s.slot and vals.v = {_pick("s.id", "'42:s' || s.i", "sizes.k")}),
g as (select id, list(value order by i) as v from f group by id)
select c.id, family, parts[1] || array_to_string(list_transform(range(1, len(v) + 1), lambda i: v[i] || parts[i + 1]), '') as text, len(v) as n, cast(length(parts[1]) + case when len(v) > 1 then length(v[1]) + length(parts[2]) else 0 end as integer) as last_two from c join g using (id)"""


def _expanded(t: Tables, rows: tuple):
    out = X.expand(t.documents.select(F.col("doc_id").alias("id")), rows, values(t))
    second = F.when(F.size("entities") > 1, F.expr("entities[1].start")).otherwise(F.expr("entities[0].start"))
    return out.select("id", "family", "text", F.size("entities").cast("long").alias("n"), second.alias("last_two"))


@query(_expand_sql(X.TEMPLATES))
def expand_templates(t: Tables):
    return _expanded(t, X.TEMPLATES)


@query(_expand_sql(X.BOUNDARY_TEMPLATES))
def boundary_cases(t: Tables):
    return _expanded(t, X.BOUNDARY_TEMPLATES)


@query("with w as (select event_type as family, count(*) as weight from events group by 1) select family, cast(greatest(floor(5000 * weight / (select sum(weight) from w)), 1) as bigint) as n from w")
def allocate_counts(t: Tables):
    return X.allocate_counts(t.events.groupBy(F.col("event_type").alias("family")).agg(F.count(F.lit(1)).alias("weight")), 5000, 1)


@query(
    f"""with rel as (select n_nationkey as v, n_name as relation, case when n_nationkey % 2 = 0 then 'f' else 'm' end as gender from nation),
nam as (select case when c_custkey % 2 = 0 then 'f' else 'm' end as gender, c_custkey // 2 as v, c_name as name from customer), k as (select gender, count(*) as k from nam group by 1),
a as (select doc_id as id, relation, rel.gender from documents join rel on rel.v = {_pick("doc_id", "'42:r'", "(select count(*) from rel)")})
select a.id, relation, name from a join k using (gender) join nam on nam.gender = a.gender and nam.v = {_pick("a.id", "'42:n'", "k.k")}"""
)
def gendered_slot(t: Tables):
    sex = lambda c: F.when(F.col(c) % 2 == 0, "f").otherwise("m")
    rel = t.nation.select(F.col("n_nationkey").cast("long").alias("v"), F.col("n_name").alias("relation"), sex("n_nationkey").alias("gender"))
    names = t.customer.select(sex("c_custkey").alias("gender"), F.floor(F.col("c_custkey") / 2).alias("v"), F.col("c_name").alias("name"))
    return X.gendered(t.documents.select(F.col("doc_id").alias("id")), rel, names)


_AFFIX = [(p, s) for p in X.PREFIXES for s in X.SUFFIXES]


@query(
    "with a(k, p, s) as (values " + ", ".join(f"({k}, '{p}', '{s}')" for k, (p, s) in enumerate(_AFFIX)) + """), v as (select item_id || '-' || k as key, case when k = 0 then 0 else 1 end as tier,
  p || case when p = '' then text else lower(substr(text, 1, 1)) || substr(text, 2) end || s as text from benchmark, a),
r as (select *, row_number() over (partition by tier order by md5('42:' || key), key) as r from v), n as (select count(*) as n from benchmark)
select key, text from r, n where (tier = 0 and r <= 300) or (tier = 1 and r <= 300 - n)"""
)
def negative_expansion(t: Tables):
    return X.negative_expansion(t.benchmark.select(F.col("item_id").alias("no"), "text"), X.PREFIXES, X.SUFFIXES, 300)


@query(
    """with w as (select item_id as id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from benchmark), b as (select id, w, unnest([50, 100, 200, 400]) as bucket from w),
n as (select *, cast(floor(bucket * (1 / 1.3)) as integer) as n from b) select id, bucket, array_to_string(list_transform(range(0, n), lambda i: w[i % len(w) + 1]), ' ') as text from n"""
)
def length_bucket_inputs(t: Tables):
    return X.length_bucket_inputs(t.benchmark.select(F.col("item_id").alias("id"), "text"))


# ---- streams over the same files


def _calls(t: Tables):
    return derive(J.read_stream(t.spark, t._dir, "events"), U.CALL).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"with {U.CALLS} select org_id, date_trunc('minute', ts) as minute, count(*) as n from calls group by all")
def stream_rate_counts(t: Tables):
    return J.drain(J.rate_counts(_calls(t), "org_id"), ["org_id", "minute"])


@query(f"with {U.CALLS}, {U.DAILY} select org_id, day, {', '.join(f'n_{o}' for o in U.M.OPS)}, tokens from daily")
def stream_usage_daily(t: Tables):
    return J.drain(J.usage_daily(_calls(t), U.M.OPS), ["org_id", "day"])


@query(f"with {U.CALLS} select event_id, substr(sha256(cast(org_id as varchar)), 1, 12) as org, op as operation, tokens, round(duration_ms, 3) as duration_ms from calls")
def stream_audit(t: Tables):
    return J.drain(J.audit(_calls(t)))


_CAP = 1000
ORACLE_QUOTA = ORACLES["monthly_quota"].replace(U.PLAN, f"plan as (select distinct user_id % 20 as org_id, {_CAP} as cap from events)")


@query(ORACLE_QUOTA)
def stream_monthly_quota(t: Tables):
    return J.monthly_quota(_calls(t), F.lit(_CAP))


@query(ORACLES["tokenize_emails"])
def stream_tokenize(t: Tables):
    keys = T.key_pads(t.spark.range(1).select(F.lit(_DEK).cast("binary").alias("dek"))).select("ipad", "opad")
    return J.drain(J.tokenize(J.read_stream(t.spark, t._dir, "documents").select("doc_id", "text"), keys))


_WRITE = {"org_id": "user_id % 7", "request_id": "user_id % 10", "token_hash": "concat('h', cast(event_id % 20 as string))", "created_at": "ts"}
_TTL, _LATE = 3600, 120


@query(
    f"""with v as ({select(_WRITE, 'events')}), w as (select *, lag(created_at) over k as before, lead(created_at) over k as after from v window k as (partition by org_id, request_id, token_hash order by created_at)),
e as (select max(created_at) - interval '{_LATE}' second as mark from v)
select org_id, request_id, token_hash, 'stored' as event, date_trunc('millisecond', created_at) as at from w where before is null or created_at >= before + interval '{_TTL}' second
union all select org_id, request_id, token_hash, 'expired', date_trunc('millisecond', created_at) + interval '{_TTL}' second from w, e
where after >= created_at + interval '{_TTL}' second or (after is null and created_at + interval '{_TTL}' second <= mark)"""
)
def stream_vault_ttl(t: Tables):
    """Keys begin to live when written and expire an hour of event time after their last write."""
    rows = derive(J.read_stream(t.spark, t._dir, "events"), _WRITE).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return J.drain(J.vault_ttl(rows, _TTL, f"{_LATE} seconds"))


@query(ORACLES["tokenize_turns"])
def stream_tokenize_turns(t: Tables):
    """Conversations tokenised as a stream: the texts of a request share tokens, orgs without a key get none."""
    turns = derive(J.read_stream(t.spark, t._dir, "conversations"), DT._TURN)
    kind = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit("org").alias("pii_type"))
    turns = turns.withColumn("spans", F.transform(DT.S.find_all(F.coalesce("text", F.lit("")), DT._LONG_WORD), kind))
    return J.drain(J.tokenize_requests(turns, DT.key_table(t), "spans", 4))
