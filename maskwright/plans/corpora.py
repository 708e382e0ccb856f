"""Queries of corpus conversion, cleaning, validation, formatting and splitting.

Token rows are the words of ``documents`` with tags derived from their place; annotated
examples are derived from ``customer`` by expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import corpus as C
from maskwright.plans.registry import ORACLES, QUERIES, Tables, query
from maskwright.sources import corpora as R

# ---- languages and splits


@query("select doc_id, lang from documents where lang in ('fr', 'es')")
def language_filter(t: Tables):
    return R.language_filter(t.documents, ["fr", "es"]).select("doc_id", "lang")


@query("select doc_id, lang, n_chars from documents")
def read_raw_parquet(t: Tables):
    return R.read_raw_parquet(t.spark, f"{t._dir}/documents.parquet").select("doc_id", "lang", "n_chars")


_H = "md5('42:' || doc_id)"


@query(
    f"""with e as (select doc_id, lang, row_number() over (order by {_H}, doc_id) as r from documents where lang = 'en'), n as (select floor(count(*) * 0.3) as n from documents where lang = 'fr')
select doc_id, lang from documents where lang = 'fr' union all select doc_id, lang from e, n where r <= n"""
)
def language_mix_sample(t: Tables):
    return R.language_mix(t.documents, "fr", "en", 0.3, "doc_id").select("doc_id", "lang")


_SPLIT = "case doc_id % 4 when 0 then 'train' when 1 then 'val' when 2 then 'test' else 'train' end"


@query(
    f"""with d as (select doc_id, lang, {_SPLIT} as split from documents),
e as (select *, row_number() over (partition by split order by {_H}, doc_id) as r from d where lang = 'en'), n as (select split, floor(count(*) * 0.3) as n from d where lang = 'fr' group by split)
select doc_id, lang, split from d where lang = 'fr' union all select doc_id, lang, split from e join n using (split) where r <= n"""
)
def split_name_consolidate(t: Tables):
    raw = F.element_at(F.array(*map(F.lit, ("train_it", "validation", "test-en", "Train"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = t.documents.select("doc_id", "lang", R.canonical_split(raw).alias("split"))
    return R.language_mix(d, "fr", "en", 0.3, "doc_id", ["split"]).select("doc_id", "lang", "split")


_GROUP = "case when doc_id % 5 = 0 then null else source end"


@query(
    f"""with d as (select doc_id, lang, {_GROUP} as source from documents), e as (select *, row_number() over (partition by source order by {_H}, doc_id) as r from d where lang = 'en'),
n as (select source, floor(count(*) * 0.4) as n from d where lang = 'fr' group by source)
select doc_id, lang, source from d where lang = 'fr' union all select doc_id, lang, e.source from e join n on e.source is not distinct from n.source where r <= n"""
)
def language_mix_by_source(t: Tables):
    """By source; a fifth of the rows has none."""
    d = t.documents.selectExpr("doc_id", "lang", f"{_GROUP} as source")
    return R.language_mix(d, "fr", "en", 0.4, "doc_id", ["source"]).select("doc_id", "lang", "source")


_RAW_SPLIT = "concat(case doc_id % 4 when 0 then 'train' when 1 then 'validation' when 2 then 'test' else 'Train' end, case doc_id % 7 when 0 then '' else '_' || lang end)"


@query(
    f"""with d as (select doc_id, case split_part(lower(s), '_', 1) when 'validation' then 'val' else split_part(lower(s), '_', 1) end as split, split_part(s, '_', 2) as mark from (select doc_id, {_RAW_SPLIT} as s from documents)),
e as (select *, row_number() over (partition by split order by {_H}, doc_id) as r, count(*) over (partition by split) as n from d where mark = 'en')
select doc_id, split from d where mark = 'fr' union all select doc_id, split from e where r <= floor(n * 0.3)"""
)
def split_names_by_language(t: Tables):
    d = t.documents.selectExpr("doc_id", f"{_RAW_SPLIT} as raw")
    return R.consolidate_splits(d, "raw", "fr", "en", 0.3, "doc_id").select("doc_id", "split")


@query(f"select doc_id, {_RAW_SPLIT} as split from documents")
def split_names_without_a_match(t: Tables):
    d = t.documents.selectExpr("doc_id", f"{_RAW_SPLIT} as raw")
    return R.consolidate_splits(d, "raw", "xx", "yy", 0.3, "doc_id").select("doc_id", "split")


# ---- tagged tokens

_TOK = "tok as (select doc_id, i, token, (doc_id * 7 + i * i) % 11 as tag from (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as i from (select doc_id, string_split(text, ' ') as w from documents)))"
_NAMES = "[" + ", ".join(f"'{x}'" for x in C.WIKINEURAL_LABELS) + "]"
_LAB = f"""lab as (select *, case when tag < 9 then ({_NAMES})[tag + 1] else 'O' end as label from tok),
pos as (select *, cast(sum(length(token) + 1) over (partition by doc_id order by i) - length(token) - 1 as integer) as s from lab)"""


def _bio_sql(mode: str) -> str:
    starts = "label like 'B-%'" if mode != "open" else "(label like 'B-%' or (label like 'I-%' and coalesce(substr(lag(label) over w, 3), '') <> substr(label, 3)))"
    bad = {"drop": "not (starts or (label like 'I-%' and substr(label, 3) = first_value(substr(label, 3)) over (partition by doc_id, g order by i)))", "extend": "label = 'O'", "open": "label = 'O'"}[mode]
    return f"""with {_TOK}, {_LAB},
a as (select *, {starts} as starts from pos window w as (partition by doc_id order by i)), b as (select *, sum(starts::int) over (partition by doc_id order by i) as g from a),
c as (select *, sum(({bad})::int) over (partition by doc_id, g order by i) as broken from (select *, {bad} as x from b)),
d as (select doc_id, g, min(s) as "start", max(s + length(token)) as "end", arg_min(substr(label, 3), i) as type from c where g > 0 and broken = 0 group by doc_id, g)
select doc_id, "start", cast("end" as integer) as "end", type from d""".replace(f"sum(({bad})::int)", "sum(x::int)")


def tagged(t: Tables):
    words = t.documents.select("doc_id", F.split("text", " ").alias("tokens"))
    tags = F.transform("tokens", lambda w, i: ((F.col("doc_id") * 7 + (i + 1) * (i + 1)) % 11).cast("int"))
    named = words.select("doc_id", "tokens", tags.alias("tags"))
    return named.select("doc_id", "tokens", C.label_names(F.col("tags"), C.WIKINEURAL_LABELS).alias("labels"))


def _rows(df):
    long = df.select("doc_id", F.explode_outer("spans").alias("x")).where("x is not null")
    return long.select("doc_id", "x.start", "x.end", "x.type")


@query(_bio_sql("drop"))
def bio_to_spans(t: Tables):
    return _rows(tagged(t).select("doc_id", C.fold_labels(F.col("tokens"), F.col("labels"), "drop").alias("spans")))


@query(_bio_sql("extend"))
def bio_str_to_spans(t: Tables):
    return _rows(tagged(t).select("doc_id", C.fold_labels(F.col("tokens"), F.col("labels"), "extend").alias("spans")))


@query(_bio_sql("open"))
def bio_decode(t: Tables):
    return _rows(tagged(t).select("doc_id", C.fold_labels(F.col("tokens"), F.col("labels"), "open").alias("spans")))


@query(_bio_sql("extend").replace("from pos window", "from (select * from pos where token <> '') window"))
def align_tokens_to_spans(t: Tables):
    """Tokens searched in the document's text, one behind the other; empty ones (two spaces) are left out."""
    own = tagged(t).select("doc_id", F.filter(F.arrays_zip("tokens", "labels"), lambda x: x["tokens"] != "").alias("x"))
    both = own.join(t.documents.select("doc_id", "text"), "doc_id")
    return _rows(both.select("doc_id", C.fold_labels(F.transform("x", lambda x: x["tokens"]), F.transform("x", lambda x: x["labels"]), "extend", F.col("text")).alias("spans")))


@query(
    f"""with {_TOK}, x as (select doc_id, list(case when (doc_id + i) % 97 = 0 then 99 when tag = 10 then -100 else tag end order by i) as l from tok group by doc_id),
y as (select doc_id, unnest(l) as v, generate_subscripts(l, 1) - 1 as i from x), z as (select *, case when v = -100 then null when v = 99 then 'O' else ([{", ".join(f"'{n}'" for n in C.NER_LABELS)}])[v + 1] end as n from y),
p as (select *, coalesce(lag(n) over (partition by doc_id order by i), 'O') as before from z where v <> -100)
select doc_id, cast(min(case when n like 'I-%' and (before = 'O' or substr(before, 3) <> substr(n, 3)) then i end) as integer) as bad_bio, cast(min(case when v = 99 then i end) as integer) as bad_range from documents d left join p using (doc_id) group by doc_id"""
)
def validate_bio_rows(t: Tables):
    own = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    ids = F.transform("w", lambda w, i: ((F.col("doc_id") * 7 + (i + 1) * (i + 1)) % 11).cast("int"))
    ids = F.transform(ids, lambda x, i: F.when((F.col("doc_id") + i + 1) % 97 == 0, 99).when(x == 10, C.IGNORE).otherwise(x))
    return C.validate_bio(own.select("doc_id", ids.alias("labels"))).select("doc_id", "bad_bio", "bad_range")


@query(
    """with w as (select item_id as doc_id, string_split(text, ' ') as w from benchmark), t as (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as i from w),
p as (select doc_id, cast(i - 1 as integer) as idx, cast(case when i % 9 = 0 then null else i // 2 end as integer) as word_id, cast(sum(length(token) + 1) over (partition by doc_id order by i) - length(token) - 1 as integer) as cs, token from t),
k as (select *, cs + length(token) as ce, lag(word_id) over (partition by doc_id order by idx) as before from p),
s as (select item_id as doc_id, k * 40 + 3 as s, k * 40 + 3 + 17 as e, ['pe', 'org', 'zz'][cast(k % 3 as integer) + 1] as type from benchmark, (select unnest(range(0, 9)) as k)),
j as (select k.doc_id, idx, word_id, before, cs, min((s.s, s.e, s.type)) as b from k left join s on s.doc_id = k.doc_id and cs < s.e and ce > s.s group by all)
select doc_id, idx, cast(case when word_id is null or word_id = coalesce(before, -1) then -100 when b[1] is null then 0 when b[3] = 'zz' then 0
  else case when b[3] = 'pe' then 1 else 3 end + case when cs <= b[1] then 0 else 1 end end as integer) as label from j""".replace("b[3]", "struct_extract(b, 3)").replace("b[1]", "struct_extract(b, 1)")
)
def spans_to_bio(t: Tables):
    w = t.benchmark.select(F.col("item_id").alias("doc_id"), F.split("text", " ").alias("w"))
    ends = F.aggregate("w", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x) + 1)))
    long = w.select("doc_id", "w", ends.alias("ends")).select("doc_id", F.posexplode_outer(F.arrays_zip("w", "ends")).alias("idx", "x"))
    i = F.col("idx") + 1
    tokens = long.select("doc_id", "idx", F.when(i % 9 != 0, F.floor(i / 2).cast("int")).alias("word_id"), (F.col("x.ends") - 1 - F.length("x.w")).alias("cs"), (F.col("x.ends") - 1).alias("ce"))
    k = t.benchmark.select(F.col("item_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    spans = k.select("doc_id", (F.col("k") * 40 + 3).alias("start"), (F.col("k") * 40 + 20).alias("end"), F.element_at(F.array(F.lit("pe"), F.lit("org"), F.lit("zz")), F.col("k") % 3 + 1).alias("type"))
    return C.spans_to_bio(tokens, spans)


# ---- annotated examples: six entities a customer, some of them wrong

_ENT = (
    ("case when c_custkey % 3 = 0 then 'pe' else 'org' end", "case when c_custkey % 2 = 0 then concat('AB', cast(c_custkey % 97 as string)) else 'Mario Rossi' end"),
    ("'ind'", "cast(c_custkey * 13 % 20000 as string)"),
    ("'dt'", "case when c_custkey % 4 = 0 then '2020-01-02' else 'marzo scorso' end"),
    ("'med'", "case when c_custkey % 5 = 0 then 'Clinica Rosa' else 'gastrite' end"),
    ("'org'", "case when c_custkey % 3 = 1 then 'Milano' else c_mktsegment end"),
    ("'loc'", "case when c_custkey % 6 = 0 then 'a.b@example.org' else c_name end"),
)
_ENTROWS = " union all ".join(f"select c_custkey as doc_id, {i} as i, {k} as type, {v} as text, concat('src', cast(c_custkey % 4 as string)) as source from customer" for i, (k, v) in enumerate(_ENT))
ENTITIES = f"ent0 as ({_ENTROWS}), ent as (select *, cast(sum(length(text) + 1) over (partition by doc_id order by i) - length(text) - 1 as integer) as s from ent0)"


def examples(t: Tables):
    """(doc_id, source, text, entities) with true offsets."""
    pieces = F.array(*(F.struct(F.expr(k).alias("type"), F.expr(v).alias("text")) for k, v in _ENT))
    base = t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("src"), (F.col("c_custkey") % 4).cast("string")).alias("source"), pieces.alias("p"))
    kind = "array<struct<text:string,type:string,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    step = lambda a, x: F.struct(
        (a["pos"] + F.length(x["text"]) + 1).alias("pos"),
        F.concat(a["out"], F.array(F.struct(x["text"].alias("text"), x["type"].alias("type"), a["pos"].alias("start"), (a["pos"] + F.length(x["text"])).alias("end")))).alias("out"),
    )
    return base.select("doc_id", "source", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), F.aggregate("p", start, step, lambda a: a["out"]).alias("entities"))


def entities(t: Tables):
    return examples(t).select("doc_id", "source", F.col("text").alias("doc"), F.posexplode_outer("entities").alias("i", "x")).select("doc_id", "source", "doc", "i", "x.*")


_MAPPED = "m(d, k, v) as (values " + ", ".join(f"('{d}', '{k}', '{v}')" for (d, k), v in C.TYPE_MAP.items()) + ")"
_SRC = "case doc_id % 4 when 0 then 'multinerd' when 1 then 'wikineural' when 2 then 'humadex' else 'ai4privacy' end"
_KIND = "case (doc_id + i) % 6 when 0 then 'per' when 1 then 'ORG' when 2 then 'DISEASE' when 3 then 'CITY' when 4 then 'GENDER' else 'DOB' end"


@query(f"with {ENTITIES}, {_MAPPED}, x as (select doc_id, i, {_SRC} as dataset, {_KIND} as type from ent) select doc_id, i, v as code, case when v is null then 'unmapped:' || upper(type) end as reject_reason from x left join m on d = dataset and k = upper(type)")
def map_entity_type(t: Tables):
    x = entities(t).select("doc_id", "i", F.expr(_SRC).alias("dataset"), F.expr(_KIND).alias("type"))
    return C.map_types(x).select("doc_id", "i", "code", "reject_reason")


@query(
    f"""with {ENTITIES}, d as (select doc_id, string_agg(text, ' ' order by i) as doc from ent group by doc_id),
x as (select doc_id, i, text, upper(type) as label, case when i % 2 = 0 then s else instr(doc, text) - 1 end as s from ent join d using (doc_id))
select doc_id, i, cast(s as integer) as "start", cast(s + length(text) as integer) as "end", text, label from x where doc_id % 10 <> 9"""
)
def parse_span_list(t: Tables):
    """Offsets are given for even places only; the others are searched, and found at their first place."""
    items = F.transform(
        "entities",
        lambda x, i: F.struct(
            F.when(i % 2 == 0, x["type"]).alias("label"), F.when(i % 2 == 1, x["type"]).alias("entity_type"), F.when(i % 3 == 0, x["text"]).alias("value"), F.when(i % 3 != 0, x["text"]).alias("text"),
            F.when(i % 2 == 0, x["start"]).alias("start"), F.when(i % 2 == 0, x["end"]).alias("end"),
        ),
    )
    rows = examples(t).select("doc_id", "text", F.when(F.col("doc_id") % 10 == 9, "{broken").otherwise(F.to_json(items)).alias("j"))
    long = rows.select("doc_id", F.posexplode_outer(C.parse_span_json(F.col("text"), F.col("j"))).alias("i", "x")).where("x is not null")
    return long.select("doc_id", "i", "x.start", "x.end", "x.text", "x.label")


@query(f"with {ENTITIES} select doc_id, i, upper(type) as label, text from ent")
def parse_label_string(t: Tables):
    joined = F.array_join(F.transform("entities", lambda x: F.concat(x["type"], F.lit(": "), x["text"])), ", ")
    long = examples(t).select("doc_id", F.posexplode_outer(C.parse_label_string(F.concat(joined, F.lit(", nonsense")))).alias("i", "x"))
    return long.select("doc_id", "i", "x.label", "x.text")


@query(f"with {ENTITIES} select doc_id, i, s as \"start\", text from ent")
def parse_annotation_list(t: Tables):
    notes = F.to_json(F.transform("entities", lambda x: F.struct(x["type"].alias("label"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = examples(t).select("doc_id", "text", F.from_json(notes, "array<struct<label:string,start:int,end:int>>").alias("a"))
    long = rows.select("doc_id", "text", F.posexplode_outer("a").alias("i", "x"))
    return long.select("doc_id", "i", "x.start", F.expr("substring(text, x.start + 1, x.end - x.start)").alias("text"))


_LOOKS = " or ".join("regexp_full_match(trim(text), '" + r.replace("'", "''") + "')" for r in C.REGEX_ENTITY)


@query(f"with {ENTITIES} select doc_id, i, text from ent where not ({_LOOKS})")
def exclude_regex_entities(t: Tables):
    return entities(t).where(~C.looks_like_pattern(F.col("text"))).select("doc_id", "i", "text")


@query(f"with {ENTITIES} select doc_id, i, (doc_id + i) % 5 <> 0 as ok from ent")
def check_offsets(t: Tables):
    moved = F.when((F.col("doc_id") + F.col("i")) % 5 == 0, 1).otherwise(0)
    return entities(t).select("doc_id", "i", C.offsets_hold(F.col("doc"), F.col("start") + moved, F.col("end") + moved, F.col("text")).alias("ok"))


@query(f"with {ENTITIES} select doc_id, count(*) as n from ent where not ({_LOOKS}) and type in ('dt', 'med') and (doc_id + i) % 2 = 0 group by doc_id")
def drop_empty_examples(t: Tables):
    keep = lambda x, i: ~C.looks_like_pattern(x["text"]) & x["type"].isin("dt", "med") & ((F.col("doc_id") + i) % 2 == 0)
    kept = examples(t).select("doc_id", F.filter("entities", keep).alias("e"))
    return kept.select("doc_id", F.size("e").cast("long").alias("n")).where("n > 0")


@query(f"with {ENTITIES}, {_MAPPED}, x as (select source, v as code, case when v is null then 'unmapped:' || upper({_KIND}) end as reason from ent left join m on d = {_SRC} and k = upper({_KIND})) select source, code, reason, count(*) as n from x group by grouping sets ((source), (source, code), (source, reason))")
def conversion_stats(t: Tables):
    x = entities(t).select("source", "doc_id", "i", F.expr(_SRC).alias("dataset"), F.expr(_KIND).alias("type"))
    mapped = C.map_types(x).withColumnRenamed("reject_reason", "reason")
    return mapped.groupingSets([["source"], ["source", "code"], ["source", "reason"]], "source", "code", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- cleaning

_WHY = rf"""case when type = 'pe' and regexp_matches(text, '^[a-zA-Z0-9]{{3,12}}$') and regexp_matches(text, '[0-9]') and regexp_matches(text, '[a-zA-Z]') then 'pe_code'
  when type = 'ind' and regexp_matches(text, '^[0-9]+$') and length(text) < 5 then 'ind_bare_number'
  when type = 'dt' and regexp_matches(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then 'dt_structured'
  when type = 'med' and regexp_matches(text, '(?i){C.MED_FACILITY}') then 'med_facility' end"""
_CITY = f"(type = 'org' and regexp_matches(text, '{C.CITY_LIKE}') and lower(text) in ({', '.join(repr(c) for c in C.CITIES)}))"


@query(f"with {ENTITIES} select doc_id, i, {_WHY} as reason, {_CITY} as is_city from ent")
def clean_entities(t: Tables):
    return entities(t).select("doc_id", "i", C.clean_reason(F.col("type"), F.col("text")).alias("reason"), C.org_city(F.col("type"), F.col("text")).alias("is_city"))


for _rule in ("pe_code", "ind_bare_number", "dt_structured", "med_facility"):

    def _drop(t: Tables, rule: str = _rule):
        return entities(t).where(C.clean_reason(F.col("type"), F.col("text")) == rule).select("doc_id", "i", "text")

    query(f"with {ENTITIES} select doc_id, i, text from (select *, {_WHY} as w from ent) where w = '{_rule}'", f"drop_{_rule}")(_drop)


@query(f"with {ENTITIES} select doc_id, i, text from ent where {_CITY}")
def flag_org_city(t: Tables):
    return entities(t).where(C.org_city(F.col("type"), F.col("text"))).select("doc_id", "i", "text")


@query(
    f"""with {ENTITIES}, w as (select *, {_WHY} as w, {_CITY} as c from ent) select source as _source, count(*) as n_in, count(*) filter (w is null) as n_out, """
    + ", ".join(f"count(*) filter (w = '{r}') as n_{r}" for r in ("pe_code", "ind_bare_number", "dt_structured", "med_facility"))
    + ", count(*) filter (c and w is null) as n_org_city from w group by rollup(source)"
)
def cleaning_report(t: Tables):
    return C.cleaning_report(entities(t).select(F.col("source").alias("_source"), "type", "text"))


# ---- validation: examples made wrong in known ways


def wrong(t: Tables):
    k = F.col("doc_id") % 8
    change = lambda x, i: F.struct(
        x["text"].alias("text"),
        F.when((k == 2) & (i == 1), "zz").when((k == 3) & (i == 2), F.lit(None).cast("string")).otherwise(x["type"]).alias("type"),
        F.when((k == 4) & (i == 1), -1).otherwise(x["start"]).alias("start"),
        F.when((k == 1) & (i == 0), x["end"] + 1).otherwise(x["end"]).alias("end"),
    )
    e = examples(t)
    swapped = F.when(k == 5, F.reverse("entities")).otherwise(F.transform("entities", change))
    return e.select("doc_id", "source", F.when(k != 6, F.col("text")).alias("text"), F.when(k != 7, swapped).alias("entities"))


_REASON = "case doc_id % 8 when 1 then 'offset_mismatch' when 2 then 'invalid_label_zz' when 3 then 'entity_missing_keys' when 4 then 'offset_out_of_bounds' when 5 then 'overlapping_entities' when 6 then 'missing_text' when 7 then 'missing_entities_key' end"


@query(f"select c_custkey as doc_id, {_REASON.replace('doc_id', 'c_custkey')} as reason from customer")
def validate_spans(t: Tables):
    return C.validate_spans(wrong(t)).select("doc_id", "reason")


@query(f"select reason, count(*) as n from (select {_REASON.replace('doc_id', 'c_custkey')} as reason from customer) group by reason")
def filter_valid(t: Tables):
    return C.validate_spans(wrong(t)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {ENTITIES}, j as (select doc_id, cast(to_json(list({{'t': text, 'y': type, 's': s, 'e': s + length(text)}} order by i)) as varchar) as answer, string_agg(text, ' ' order by i) as said from ent group by doc_id)
select doc_id, said, answer from j"""
)
def to_chat(t: Tables):
    m = C.to_chat(examples(t).select("doc_id", "text", "entities"))
    return m.select("doc_id", F.expr("messages[1].content").alias("said"), F.expr("messages[2].content").alias("answer"))


@query(f"with {ENTITIES} select doc_id, i, text, type, s as \"start\" from ent where doc_id % 9 <> 0")
def read_chat(t: Tables):
    m = C.to_chat(examples(t).select("doc_id", "text", "entities"))
    broken = m.withColumn("messages", F.when(F.col("doc_id") % 9 == 0, F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit("?"), x["content"]).alias("content")))).otherwise(F.col("messages")))
    long = R.read_chat(broken).select("doc_id", F.posexplode_outer("entities").alias("i", "x")).where("x is not null")
    return long.select("doc_id", "i", F.col("x.t").alias("text"), F.col("x.y").alias("type"), F.col("x.s").alias("start"))


@query(f"with {ENTITIES} select doc_id, i, text, type, s as \"start\" from ent")
def normalize_entity_keys(t: Tables):
    mixed = F.to_json(F.transform("entities", lambda x, i: F.struct(F.when(i % 2 == 0, x["text"]).alias("text"), F.when(i % 2 == 0, x["type"]).alias("type"), F.when(i % 2 == 0, x["start"]).alias("start"), F.when(i % 2 == 1, x["text"]).alias("t"), F.when(i % 2 == 1, x["type"]).alias("y"), F.when(i % 2 == 1, x["start"]).alias("s"))))
    parsed = examples(t).select("doc_id", F.from_json(mixed, f"array<{R.ENTITY}>").alias("e"))
    long = parsed.select("doc_id", F.posexplode_outer(R.normalize_keys(F.col("e"))).alias("i", "x"))
    return long.select("doc_id", "i", "x.text", "x.type", "x.start")


_FATAL = "case doc_id % 7 when 1 then 'message_count' when 2 then 'message_roles' when 3 then 'assistant_json' when 4 then 'assistant_is_list' when 5 then 'has_messages' end"


@query(f"select c_custkey as doc_id, {_FATAL.replace('doc_id', 'c_custkey')} as fatal, c_custkey % 7 = 6 as prompt_differs from customer")
def validate_chat_structure(t: Tables):
    k = F.col("doc_id") % 7
    m = C.to_chat(examples(t).select("doc_id", "text", "entities"))
    content = lambda x, i: F.when((k == 3) & (i == 2), "[oops").when((k == 4) & (i == 2), "{}").when((k == 6) & (i == 0), "other").otherwise(x["content"])
    role = lambda x, i: F.when((k == 2) & (i == 0), "user").otherwise(x["role"])
    changed = F.transform("messages", lambda x, i: F.struct(role(x, i).alias("role"), content(x, i).alias("content")))
    rows = m.withColumn("messages", F.when(k == 1, F.slice(changed, 1, 2)).when(k != 5, changed))
    return C.validate_chat(rows).select("doc_id", "fatal", "prompt_differs")


@query(
    f"""with {ENTITIES}, x as (select doc_id, i, type, text, s, s + length(text) as e from ent),
y as (select doc_id, i, text, case when i = 3 and doc_id % 3 = 0 then 'em' when i = 2 and doc_id % 4 = 0 then 'zz' else type end as type, case when i = 5 and doc_id % 5 = 0 then s - 3 else s end as s, case when i = 4 and doc_id % 6 = 0 then 9999 else e end as e from x),
d as (select doc_id, string_agg(text, ' ' order by i) as doc from x group by doc_id),
z as (select y.*, doc, exists(select 1 from y p where p.doc_id = y.doc_id and p.i < y.i and y.s < p.e and y.e > p.s) as hit from y join d using (doc_id))
select doc_id, cast(i as integer) as place, error from (select doc_id, i, unnest([case when type in ('em', 'zz') then 'entity_type_valid' end, case when type = 'em' then 'no_regex_types' end,
  case when s < 0 or e > length(doc) or s >= e then 'offset_bounds' when substr(doc, s + 1, e - s) <> text then 'offset_alignment' end, case when hit then 'no_overlap' end]) as error from z) where error is not null"""
)
def validate_chat_entities(t: Tables):
    d = F.col("doc_id")
    change = lambda x, i: F.struct(
        x["text"].alias("t"),
        F.when((i == 3) & (d % 3 == 0), "em").when((i == 2) & (d % 4 == 0), "zz").otherwise(x["type"]).alias("y"),
        F.when((i == 5) & (d % 5 == 0), x["start"] - 3).otherwise(x["start"]).alias("s"),
        F.when((i == 4) & (d % 6 == 0), 9999).otherwise(x["end"]).alias("e"),
    )
    return C.validate_entities(examples(t).select("doc_id", "text", F.transform("entities", change).alias("entities")))


@query(
    f"""with {ENTITIES}, t as (select source, type, count(*) as n from ent group by all) pivot (select * from t) on source in ('src0', 'src1', 'src2', 'src3') using coalesce(sum(n), 0)::bigint group by type"""
)
def validation_report(t: Tables):
    return entities(t).groupBy("type").pivot("source", ["src0", "src1", "src2", "src3"]).agg(F.count(F.lit(1))).na.fill(0)


_PART = "case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'val' else 'test' end"


@query(
    f"""with {ENTITIES}, e as (select distinct doc_id, source, {_PART} as split from ent), m as (select split, 'examples' as kind, 'all' as name from e union all select split, 'source', source from e where doc_id % 11 <> 0
  union all select split, 'source', null from e where doc_id % 11 = 0 union all select split, 'type', 'EMPTY' from e where doc_id % 7 = 0 union all select {_PART}, 'type', type from ent where doc_id % 7 <> 0)
select kind, name, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test, count(*) as total from m group by kind, name"""
)
def validation_report_by_split(t: Tables):
    """Some examples have no entities, some no source."""
    d = F.col("doc_id")
    x = examples(t).withColumn("split", F.expr(_PART)).withColumn("source", F.when(d % 11 != 0, F.col("source")))
    return C.validation_report(x.withColumn("entities", F.when(d % 7 != 0, F.col("entities"))))


@query(ORACLES["validate_chat_entities"].replace("with ", "with found as (", 1).replace("with found as (", "with found as (with ", 1) + ") select *, (select count(*) from found) as n_errors from found order by doc_id, place, error limit 50")
def validation_first_errors(t: Tables):
    return C.first_errors(QUERIES["validate_chat_entities"](t.spark, t._dir), ["doc_id", "place", "error"])


@query(
    f"""with {ENTITIES}, e as (select doc_id, string_agg(text, ' ' order by i) as text, count(*) as n from ent group by doc_id),
x as (select 'converted' as s, case when doc_id % 9 = 0 then ' ' else text end as text, n from e where doc_id % 3 = 0 union all select case when doc_id % 2 = 0 then 'own' else 'synthetic' end, text, n from e where doc_id % 3 = 1 union all select 'hard_negatives', text, 0 from e where doc_id % 3 = 2)
select s as _source, count(*) as n, count(*) filter (n > 0) as n_with, count(*) filter (n = 0) as n_without from x where trim(text) <> '' group by s"""
)
def mix_three_sources(t: Tables):
    """Converted, synthetic (half with a source of their own) and negatives; some texts are blank."""
    x, d = examples(t).drop("source"), F.col("doc_id")
    parts = {
        "converted": x.where(d % 3 == 0).withColumn("text", F.when(d % 9 == 0, " ").otherwise(F.col("text"))),
        "synthetic": x.where(d % 3 == 1).withColumn("_source", F.when(d % 2 == 0, "own")),
        "hard_negatives": x.where(d % 3 == 2).drop("entities"),
    }
    return C.mix_sources(parts)[1]


# ---- mixing and splitting


@query("with x as (select doc_id, source as src, case when doc_id % 3 = 0 then 0 else 1 end as k, text from documents) select src as _source, count(*) as n, count(*) filter (k = 1) as n_with, count(*) filter (k = 0) as n_without from x where trim(text) <> '' group by src")
def mix_sources(t: Tables):
    x = t.documents.select(F.col("source").alias("_source"), "text", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("k"))
    whole = x.where("k = 0").unionByName(x.where("k = 1")).where(F.trim("text") != "")
    return whole.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k")).alias("n_with"), F.sum(1 - F.col("k")).alias("n_without"))


_TYPES = "list_filter([case when doc_id % 2 = 0 then 'pe' end, case when doc_id % 3 = 0 then 'org' end, case when doc_id % 5 = 0 then 'dt' end, case when doc_id = 7 then 'rel' end, case when doc_id = 11 then 'leg' end], lambda x: x is not null)"
_STRATA = f"st as (select doc_id, {_TYPES} as types, case when len({_TYPES}) = 0 then 'EMPTY' else array_to_string(list_sort({_TYPES}), '+') end as stratum from documents)"


def strata(t: Tables):
    k = F.col("doc_id")
    marks = F.array(F.when(k % 2 == 0, "pe"), F.when(k % 3 == 0, "org"), F.when(k % 5 == 0, "dt"), F.when(k == 7, "rel"), F.when(k == 11, "leg"))
    d = t.documents.select("doc_id", F.filter(marks, lambda x: x.isNotNull()).alias("types"))
    return d.withColumn("stratum", C.stratum(F.col("types")))


@query(f"with {_STRATA} select doc_id, stratum from st")
def stratification_key(t: Tables):
    return strata(t).select("doc_id", "stratum")


_RARE = "c as (select doc_id, types, case when count(*) over (partition by stratum) < 2 then 'RARE' else stratum end as stratum from st)"


@query(f"with {_STRATA}, {_RARE} select doc_id, stratum from c")
def collapse_rare_strata(t: Tables):
    return C.collapse_rare(strata(t)).select("doc_id", "stratum")


_STRATA_NULL = _STRATA.replace("end as stratum", "end as s0").replace("st as (select", "st as (select doc_id, types, case when doc_id % 6 = 2 then null else s0 end as stratum from (select") + ")"


@query(f"with {_STRATA_NULL}, {_RARE} select doc_id, stratum from c")
def collapse_rare_null_strata(t: Tables):
    return C.collapse_rare(_strata_null(t)).select("doc_id", "stratum")


def _strata_null(t: Tables):
    return strata(t).withColumn("stratum", F.when(F.col("doc_id") % 6 != 2, F.col("stratum")))


_SPLITS = f"""sp as (select doc_id, types, case when r <= floor(n * 0.8 + 1e-9) then 'train' when r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) then 'val' else 'test' end as split
  from (select *, row_number() over (partition by stratum order by {_H}, doc_id) as r, count(*) over (partition by stratum) as n from c))"""


@query(f"with {_STRATA}, {_RARE}, {_SPLITS} select doc_id, split from sp")
def stratified_split(t: Tables):
    return C.stratified_split(C.collapse_rare(strata(t)), "doc_id").select("doc_id", "split")


@query(f"with {_STRATA_NULL}, {_RARE}, {_SPLITS} select doc_id, split from sp")
def stratified_split_null_strata(t: Tables):
    """A sixth of the rows has no stratum: they are one."""
    return C.stratified_split(C.collapse_rare(_strata_null(t)), "doc_id").select("doc_id", "split")


@query(
    f"""with {_STRATA}, {_RARE}, {_SPLITS}, l as (select split, unnest(case when len(types) = 0 then ['EMPTY'] else types end) as type from sp)
select type, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from l group by type"""
)
def split_distribution(t: Tables):
    return C.split_distribution(C.stratified_split(C.collapse_rare(strata(t)), "doc_id"))
