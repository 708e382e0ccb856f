"""Queries of detection, fusion, tokens and the vault.

``documents`` hold emails; lines with the other kinds are derived from ``customer`` by
expressions that both engines read alike, one kind a line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions import spans as S
from maskwright.operators import detect as D
from maskwright.operators import tokens as T
from maskwright.operators import vault as V
from maskwright.plans.registry import Tables, derive, query, select

_N = "cast(c_custkey as string)"
_2 = "lpad(cast(c_custkey % {m} + {a} as string), 2, '0')"
LINE = {
    "doc_id": "c_custkey",
    "kind": "c_custkey % 8",
    "org_id": "c_nationkey % 5",
    "request_id": "c_custkey % 40",
    "text": f"""case c_custkey % 8
      when 0 then concat('CF RSSMRA', {_2.format(m=90, a=10)}, 'A', {_2.format(m=28, a=1)}, 'H', lpad(cast(c_custkey % 900 + 100 as string), 3, '0'), 'Z residente.')
      when 1 then concat('IBAN IT60X', lpad({_N}, 22, '0'), ' banca.')
      when 2 then concat('mail user', cast(c_custkey % 50 as string), '@example', cast(c_custkey % 7 as string), '.org, pec ditta', {_N}, '@pec.example.it fine')
      when 3 then concat('P IVA 0', lpad({_N}, 10, '1'), ' ditta')
      when 4 then concat('tel +39 320 ', lpad(cast(c_custkey % 10000000 as string), 7, '0'), ' ok')
      when 5 then concat('nato il ', {_2.format(m=28, a=1)}, '/', {_2.format(m=12, a=1)}, '/', cast(1950 + c_custkey % 60 as string), ' e il ', cast(c_custkey % 28 + 1 as string), ' marzo ', cast(1990 + c_custkey % 30 as string))
      when 6 then concat('born March ', cast(c_custkey % 28 + 1 as string), ', ', cast(1980 + c_custkey % 30 as string), ' in town')
      else concat('cod 9', lpad({_N}, 10, '0'), ' x') end""",
}
LINES = f"lines as ({select(LINE, 'customer')})"
#: (type, expression without the look-around that the lines do not need, confidence, kind that may match)
_SQL_PATTERNS = (
    ("cf", f"(?i){P.CODE}", 1.0, ""),
    ("ib", f"(?i){P.IBAN}", 1.0, ""),
    ("em", P.EMAIL, 1.0, ""),
    ("fin", P.VAT, 0.8, ""),
    ("tel", P.PHONE, 0.85, "where kind = 4"),
    ("dt", P.DATE, 0.9, ""),
    ("dt", f"(?i){P.DATE_IT}", 0.85, ""),
    ("dt", f"(?i){P.DATE_EN}", 0.85, ""),
    ("fin", P.VAT_OTHER, 0.65, ""),
)


def sql_find(table: str, regex: str, where: str = "") -> str:
    """(doc_id, i, start, end, text) of every match, by cutting the text at the matches."""
    r = regex.replace("'", "''")
    return f"""select doc_id, i, cast(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) as integer) as "start",
    cast(list_sum(list_transform(g[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x))) as integer) as "end", m[i] as text
  from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(text, '{r}') as m, string_split_regex(text, '{r}') as g from {table} {where}))"""


DETECTED = "found as (" + " union all ".join(f"select doc_id, \"start\", \"end\", text, '{k}' as pii_type, cast({c} as double) as confidence from ({sql_find('lines', r, w)})" for k, r, c, w in _SQL_PATTERNS) + ")"


def lines(t: Tables):
    return derive(t.customer, LINE)


def rows(df, spans: str = "spans"):
    """Spans as rows."""
    long = df.select("doc_id", F.explode_outer(spans).alias("s")).where("s is not null")
    return long.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in ("start", "end", "text", "pii_type", "confidence")))


@query(f"with {LINES}, {DETECTED} select * from found")
def detect(t: Tables):
    return rows(D.detect(lines(t)))


def _one(kind: str, regex: str, confidence: float, where: str = "") -> str:
    return f"with {LINES} select doc_id, \"start\", \"end\", text from ({sql_find('lines', regex, where)})"


for _i, (_k, _r, _c, _w) in enumerate(_SQL_PATTERNS):

    def _pattern(t: Tables, i: int = _i):
        p = P.PATTERNS[i]
        found = lines(t).select("doc_id", F.explode_outer(S.find_all(F.col("text"), p.regex, p.guard)).alias("s")).where("s is not null")
        return found.select("doc_id", "s.start", "s.end", "s.text")

    query(_one(_k, _r, _c, _w), f"pattern_{_k}_{_i}")(_pattern)


_EMAILS = f"emails as ({sql_find('documents', P.EMAIL)})"


@query(f"with {_EMAILS} select doc_id, \"start\", \"end\", text from emails")
def find_all_with_offsets(t: Tables):
    found = t.documents.select("doc_id", F.explode_outer(S.find_all(F.col("text"), P.PATTERNS[2].regex, "@")).alias("s")).where("s is not null")
    return found.select("doc_id", "s.start", "s.end", "s.text")


_FOLD_FROM, _FOLD_TO = "".join(P.LOOK_ALIKE), "".join(P.LOOK_ALIKE.values())


@query(f"select c_custkey as doc_id, concat(c_name, ' caffe ', substr('{_FOLD_TO}', cast(c_custkey % 40 as integer) + 1, 3), ' 12') as folded from customer")
def fold_confusables(t: Tables):
    odd = F.concat("c_name", F.lit(" caffè "), F.substring(F.lit(_FOLD_FROM), (F.col("c_custkey") % 40 + 1).cast("int"), F.lit(3)), F.lit(" １２"))
    return t.customer.select(F.col("c_custkey").alias("doc_id"), S.fold_confusables(odd).alias("folded"))


@query(
    f"""with {LINES}, w as (select doc_id, concat('x [#em:1234abcd] ', text, ' <user_context a>', text, '</user_context>') as text, length(text) as n from lines)
select doc_id, replace(concat('x ', repeat(chr(1), 14), ' ', substr(text, 18, n), ' ', repeat(chr(1), n + 31)), chr(1), '#') as masked from w"""
)
def mask_protected(t: Tables):
    whole = F.concat(F.lit("x [#em:1234abcd] "), "text", F.lit(" <user_context a>"), "text", F.lit("</user_context>"))
    masked = D.mask_protected(lines(t).select("doc_id", whole.alias("text")))
    return masked.select("doc_id", F.replace("_masked", F.lit("\0"), F.lit("#")).alias("masked"))


_SIMPLE_SQL = (("cf", r"\b([A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])\b"), ("ib", r"\b(IT\d{2}[A-Z]\d{22})\b"), ("em", P.SIMPLE_PATTERNS[2].regex[4:]), ("pec", P.SIMPLE_PATTERNS[5].regex[4:]), ("tel", r"(?:\+39\s?)?(?:0\d{1,4}[\s\-]?\d{4,8}|3\d{2}[\s\-]?\d{6,7})\b"))


@query(f"with {LINES} " + " union all ".join(f"select doc_id, '{k}' as pii_type, \"start\", \"end\", text from ({sql_find('lines', r)})" for k, r in _SIMPLE_SQL))
def detect_simple(t: Tables):
    wanted = tuple(p for p in P.SIMPLE_PATTERNS if p.pii_type in {k for k, _ in _SIMPLE_SQL})
    return D.detect_simple(lines(t), patterns=wanted)


_FIRM = "concat(text, ' P. IVA ', lpad(cast(doc_id as string), 11, '7'), ', codice SDI AB', lpad(cast(doc_id % 100000 as string), 5, '0'))"
#: Their span is the end of the match.
_ENDS = (("piva", P.SIMPLE_PATTERNS[4].regex, 11), ("sdi", P.SIMPLE_PATTERNS[6].regex, 7))


@query(
    f"with firm as (select doc_id, {_FIRM.replace('as string', 'as varchar')} as text from documents) "
    + " union all ".join(f"select doc_id, '{k}' as pii_type, \"start\", \"end\", text from ({sql_find('firm', r)})" for k, r in _SIMPLE_SQL)
    + "".join(f" union all select doc_id, '{k}', \"end\" - {n}, \"end\", right(text, {n}) from ({sql_find('firm', r.replace('(?Ui)', '(?i)'))})" for k, r, n in _ENDS)
)
def detect_simple_documents(t: Tables):
    """All patterns of the smaller engine over the whole texts, each with a firm's numbers behind it."""
    return D.detect_simple(t.documents.select("doc_id", F.expr(_FIRM).alias("text")))


#: Six overlapping spans for each customer, the same in both engines.
_SPAN = {
    "start": "cast((c_custkey * 7 + i * 5) % 40 as int)",
    "end": "cast((c_custkey * 7 + i * 5) % 40 + 2 + (c_custkey + i * 3) % 9 as int)",
    "pii_type": "case (c_custkey + i) % 3 when 0 then 'pe' when 1 then 'org' else 'ind' end",
    "source": "case when (c_custkey + i) % 4 = 0 then 'regex' else 'slm' end",
    "confidence": "cast(0.5 + (c_custkey + i) % 5 * 0.125 as double)",
    "priority": "cast(i as int)",
}
_BASE = "concat(rpad(c_name, 20, '.'), rpad(c_name, 20, '-'), rpad(c_name, 20, '+'))"
SPANS = "spans as (select c_custkey as doc_id, " + ", ".join(f'{e} as "{n}"' for n, e in _SPAN.items()) + " from customer, (select unnest(range(0, 6)) as i))"
BASE = f"base as (select c_custkey as doc_id, {_BASE} as text from customer)"
_STRUCT = "{'start': \"start\", 'end': \"end\", 'pii_type': pii_type, 'source': source, 'confidence': confidence}"
RESOLVED = f"""sorted as (select doc_id, list({_STRUCT} order by "start", "end" desc, priority, source, pii_type) as l from spans group by doc_id),
resolved as (select doc_id, list_reduce(l[2:], lambda a, s: case
    when s."start" >= a[-1]."end" then list_append(a, s)
    when (s.source = 'regex' and a[-1].source <> 'regex') or (not (s.source <> 'regex' and a[-1].source = 'regex') and s."end" - s."start" > a[-1]."end" - a[-1]."start") then list_append(a[:-2], s)
    else a end, [l[1]]) as l from sorted)"""
MERGED = """merged as (select doc_id, list_reduce(l[2:], lambda a, s: case
    when a[-1].pii_type = s.pii_type and s."start" - a[-1]."end" between 0 and 1 then list_append(a[:-2], {'start': a[-1]."start", 'end': s."end", 'pii_type': s.pii_type,
      'source': case when a[-1].source = 'regex' or s.source = 'regex' then 'regex' else a[-1].source end, 'confidence': (a[-1].confidence + s.confidence) / 2})
    else list_append(a, s) end, [l[1]]) as l from resolved)"""
_FLAT = 'select doc_id, s."start" as "start", s."end" as "end", s.pii_type as pii_type, s.source as source, round(s.confidence, 6) as confidence'


def overlapping(t: Tables):
    own = F.sequence(F.lit(0), F.lit(5))
    base = t.customer.select("c_custkey", F.expr(_BASE).alias("text"), F.explode(own).alias("i"))
    long = base.selectExpr("c_custkey as doc_id", "text", *(f"{e} as `{n}`" for n, e in _SPAN.items()))
    one = F.struct("start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "pii_type", "source", "confidence", "priority")
    return long.groupBy("doc_id").agg(F.first("text").alias("text"), F.collect_list(one).alias("spans"))


def _spans(df):
    long = df.select("doc_id", F.explode_outer("spans").alias("s"))
    return long.select("doc_id", "s.start", "s.end", "s.pii_type", "s.source", F.round("s.confidence", 6).alias("confidence"))


@query(f"with {SPANS}, {RESOLVED} {_FLAT} from (select doc_id, unnest(l) as s from resolved)")
def resolve_overlaps(t: Tables):
    return _spans(overlapping(t).select("doc_id", S.resolve_overlaps(F.col("spans")).alias("spans")))


@query(f"with {SPANS}, {BASE}, {RESOLVED}, {MERGED} {_FLAT}, substr(text, s.\"start\" + 1, s.\"end\" - s.\"start\") as text from (select doc_id, unnest(l) as s from merged) join base using (doc_id)")
def merge_adjacent_simple(t: Tables):
    long = D.fuse(overlapping(t)).select("doc_id", F.explode_outer("spans").alias("s"))
    return long.select("doc_id", "s.start", "s.end", "s.pii_type", "s.source", F.round("s.confidence", 6).alias("confidence"), "s.text")


_COMPAT = """list_aggregate(list_transform(range(1, len(p) + 1), lambda i: substr(text, p[i].s + 1, p[i].e - p[i].s) || case when i < len(p) and p[i + 1].s > p[i].e then ' ' else '' end), 'string_agg', '')"""


@query(f"""with {SPANS}, {BASE}, {RESOLVED}, {MERGED}, parts as (select doc_id, unnest(l) as s from resolved), whole as (select doc_id, unnest(l) as s from merged),
g as (select w.doc_id, w.s."start" as "start", any_value(w.s."end") as "end", any_value(w.s.pii_type) as pii_type, list({{'s': x.s."start", 'e': x.s."end"}} order by x.s."start") as p
  from whole w join parts x on w.doc_id = x.doc_id and x.s."start" >= w.s."start" and x.s."end" <= w.s."end" group by 1, 2)
select g.doc_id, "start", "end", pii_type, {_COMPAT} as text from g join base using (doc_id)""")
def merge_adjacent_simple_compat(t: Tables):
    """The merged text with a space for any character between the parts."""
    long = D.fuse(overlapping(t), compat=True).select("doc_id", F.explode_outer("spans").alias("s"))
    return long.select("doc_id", "s.start", "s.end", "s.pii_type", "s.text")


@query(
    f"""with {SPANS}, r as (select * from spans where source = 'regex'), m as (select * from spans where source = 'slm'),
c as (select distinct doc_id, unnest(range("start", "end")) as p from r),
k as (select doc_id, "start", "end", pii_type, (select count(*) from c where c.doc_id = m.doc_id and p >= m."start" and p < m."end") as n from m)
select doc_id, "start", "end", pii_type, 'regex' as source from r union all select doc_id, "start", "end", pii_type, 'slm' from k where n < 0.5 * ("end" - "start")"""
)
def merge_regex_model(t: Tables):
    long = overlapping(t).select("doc_id", F.explode_outer("spans").alias("s")).select("doc_id", "s.*")
    return D.merge_regex_model(long.where("source = 'regex'"), long.where("source = 'slm'"))


@query(
    f"""with {SPANS}, {BASE}, s as (select doc_id, list({{'start': "start", 'end': "end", 'pii_type': pii_type}} order by "start", "end", pii_type) as l, any_value(text) as t from spans join base using (doc_id) group by doc_id),
m as (select doc_id, t, list_reduce(l[2:], lambda a, s: case when a.l[-1].pii_type = s.pii_type
      and regexp_full_match(substr(t, a.l[-1]."end" + 1, greatest(s."start" - a.l[-1]."end", 0)), case when s.pii_type = 'ind' then '[ ,]{{1,2}}' else ' ' end)
    then {{'l': list_append(a.l[:-2], {{'start': a.l[-1]."start", 'end': s."end", 'pii_type': s.pii_type}})}} else {{'l': list_append(a.l, s)}} end, {{'l': [l[1]]}}).l as l
  from (select doc_id, replace(replace(replace(t, '.', ' '), '-', ','), '+', ' ') as t, l from s))
select doc_id, s."start" as "start", s."end" as "end", s.pii_type as pii_type from (select doc_id, unnest(l) as s from m)"""
)
def merge_adjacent_typed(t: Tables):
    text = F.translate("text", ".-+", " , ")
    own = overlapping(t).select("doc_id", text.alias("text"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["pii_type"].alias("pii_type")))).alias("l"))
    long = own.select("doc_id", F.explode_outer(S.merge_adjacent_typed(F.col("l"), F.col("text"))).alias("s"))
    return long.select("doc_id", "s.start", "s.end", "s.pii_type")


#: Labels with outer punctuation and the part that stays.
_TRIMS = (("(Rossi,", 1, 6), ("\"Bianchi\"!", 1, 8), ("S.r.l.", 0, 6), ("dott.", 0, 5), ("Verdi.", 0, 5), ("D'Amico", 0, 7), ("Mario's", 0, 5), ("[Neri (capo)]", 1, 12), ("Via Roma 1;", 0, 10), ("??", 0, 0))


@query(
    "with k(i, w, s, e) as (values " + ", ".join(f"({i}, '{w.replace(chr(39), chr(39) * 2)}', {s}, {e})" for i, (w, s, e) in enumerate(_TRIMS)) + """)
select c_custkey as doc_id, cast(length(c_name) + 1 + s as integer) as "start", cast(length(c_name) + 1 + e as integer) as "end" from customer join k on c_custkey % 10 = i where e > s"""
)
def trim_punctuation(t: Tables):
    word = F.element_at(F.array(*(F.lit(w) for w, _, _ in _TRIMS)), (F.col("c_custkey") % 10 + 1).cast("int"))
    at = F.length("c_name") + 1
    own = t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit(" "), word).alias("text"), at.alias("s"), (at + F.length(word)).alias("e"))
    cut = own.select("doc_id", S.trim_punctuation(F.col("s"), F.col("e"), F.col("text")).alias("x"))
    return cut.select("doc_id", "x.start", "x.end").where(F.col("end") > F.col("start"))


@query(f"with {LINES}, {DETECTED} select pii_type, source, count(*) as n, cast(sum(\"end\" - \"start\") as bigint) as chars from (select *, 'regex' as source from found) group by rollup(pii_type, source)")
def detection_profile(t: Tables):
    return D.detection_profile(rows(D.detect(lines(t))).withColumn("source", F.lit("regex")))


@query(
    f"""with {LINES}, {DETECTED}, m as (select doc_id, 0 as "start", 2 as "end", 'org' as pii_type, 0.85 as confidence from lines)
select doc_id, "start", "end", pii_type, confidence from found union all select doc_id, "start", "end", pii_type, confidence from m"""
)
def detect_composite(t: Tables):
    model = lines(t).select(
        "doc_id", D.model_spans(F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("org").alias("pii_type"))), F.col("text")).alias("spans")
    )
    return rows(D.detect_composite(lines(t), model)).drop("text")


_LOGITS = "select vec_id // 4 as doc_id, cast(vec_id % 4 as integer) as idx, cast(case when vec_id % 4 = 3 then null else (vec_id % 4) // 2 end as integer) as word_id, embedding[1:21] as logits from embeddings"
_LONG = "select doc_id, word_id, idx, unnest(logits) as x, unnest(range(0, len(logits))) as label from l where word_id is not null"


def _logits_sql(strategy: str) -> str:
    keep = "qualify idx = min(idx) over (partition by doc_id, word_id)" if strategy == "first" else ""
    return f"""with l as ({_LOGITS}), x as ({_LONG} {keep}), g as (select doc_id, word_id, label, {'max' if strategy == 'max' else 'avg'}(cast(x as double)) as x from x group by all)
select doc_id, word_id, cast(label as integer) as label, round(x, 5) as score from g qualify row_number() over (partition by doc_id, word_id order by x desc, label) = 1"""


for _s in ("first", "average", "max"):

    def _aggregate(t: Tables, s: str = _s):
        tokens = t.embeddings.selectExpr("vec_id div 4 as doc_id", "cast(vec_id % 4 as int) as idx", "cast(case when vec_id % 4 = 3 then null else (vec_id % 4) div 2 end as int) as word_id", "transform(slice(embedding, 1, 21), x -> cast(x as double)) as logits")
        return D.aggregate_logits(tokens, s).withColumn("score", F.round("score", 5))

    query(_logits_sql(_s), f"aggregate_subword_logits_{_s}")(_aggregate)


# ---- tokens

_DEK = "maskwright demo key"  # a fixed key of the queries only; real keys come from a key table


def _pads(secret: str) -> tuple[str, str]:
    block = secret.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def key_table(t: Tables):
    orgs = t.nation.select((F.col("n_nationkey") % 5).alias("org_id")).distinct()
    dek = F.concat(F.lit(_DEK), F.col("org_id").cast("string")).cast("binary")
    return T.key_pads(orgs.withColumn("dek", F.unhex(F.rpad(F.hex(dek), 64, "0"))))


KEYS = "pads(org_id, ipad, opad) as (values " + ", ".join(f"({i}, unhex('{_pads(_DEK + str(i))[0]}'), unhex('{_pads(_DEK + str(i))[1]}'))" for i in range(5)) + ")"
_HMAC = "substr(sha256(opad || unhex(sha256(ipad || encode({v})))), 1, {n})"


@query(f"with {LINES}, {KEYS} select doc_id, {_HMAC.format(v='text', n=8)} as hash from lines join pads using (org_id)")
def hmac_hash(t: Tables):
    return lines(t).join(key_table(t), "org_id").select("doc_id", T.hmac_hash(F.col("text"), F.col("ipad"), F.col("opad")).alias("hash"))


_TOKEN_TEXT = "concat('[#', case c_custkey % 4 when 0 then 'em' when 1 then 'zz' else 'org' end, ':', substr(sha256(cast(c_custkey as varchar)), 1, 8), case when c_custkey % 3 = 0 then '_2' else '' end, ']', case when c_custkey % 5 = 0 then ' ' else '' end)"


def token_text():
    kind = F.when(F.col("c_custkey") % 4 == 0, "em").when(F.col("c_custkey") % 4 == 1, "zz").otherwise("org")
    digest = F.substring(F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256), 1, 8)
    return F.concat(F.lit("[#"), kind, F.lit(":"), digest, F.when(F.col("c_custkey") % 3 == 0, "_2").otherwise(""), F.lit("]"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(""))


@query(f"""with x as (select c_custkey as doc_id, {_TOKEN_TEXT} as t from customer), y as (select *, regexp_full_match(t, '\\[#([a-z]{{2,3}}):([a-f0-9]{{4,8}}(?:_\\d+)?)\\]') and not contains(t, '#zz') as ok from x)
select doc_id, ok as is_token, case when ok then regexp_extract(t, '#([a-z]+)', 1) end as pii_type, case when ok then regexp_extract(t, ':([a-f0-9_]+)', 1) end as hash, case when ok then t end as again from y""")
def parse_token(t: Tables):
    x = t.customer.select(F.col("c_custkey").alias("doc_id"), token_text().alias("t"))
    p = x.select("doc_id", T.is_token(F.col("t")).alias("is_token"), T.parse_token(F.col("t")).alias("p"))
    return p.select("doc_id", "is_token", "p.pii_type", "p.hash", T.format_token(F.col("p.pii_type"), F.col("p.hash")).alias("again"))


@query(f"""with lines as (select c_custkey as doc_id, concat('a ', {_TOKEN_TEXT}, ' b ', {_TOKEN_TEXT}) as text from customer)
select doc_id, "start", "end", text from ({sql_find('lines', P.TOKEN)}) where not contains(text, '#zz')""")
def find_tokens(t: Tables):
    x = t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("a "), token_text(), F.lit(" b "), token_text()).alias("text"))
    long = x.select("doc_id", F.explode_outer(T.find_tokens(F.col("text"))).alias("m")).where("m is not null")
    return long.select("doc_id", "m.start", "m.end", "m.text")


_VALUES = "v as (select c_custkey % 40 as request_id, c_name as value, substr(sha256(cast(c_custkey % 60 as varchar)), 1, 4) as base_hash, c_custkey as place from customer)"
_NUMBERED = "case when n = 1 then base_hash when n <= 10 then base_hash || '_' || n end"


@query(f"with {_VALUES}, r as (select *, row_number() over (partition by request_id, base_hash order by place, value) as n from v) select request_id, value, base_hash, place, {_NUMBERED} as hash, n > 10 as failed from r")
def resolve_collisions(t: Tables):
    return T.resolve_collisions(_values(t))


def _values(t: Tables):
    return t.customer.select((F.col("c_custkey") % 40).alias("request_id"), F.col("c_name").alias("value"), F.substring(F.sha2((F.col("c_custkey") % 60).cast("string").cast("binary"), 256), 1, 4).alias("base_hash"), F.col("c_custkey").alias("place"))


#: Who holds each of the ten slots of a base hash.
_SLOTS = "[" + ", ".join(f"max(p.value) filter (p.slot = {i})" for i in range(1, 11)) + "]"
_CARRIED = "base_hash || case place % 4 when 0 then '' when 1 then '_3' when 2 then '_7' else '_12' end"


@query(f"""with recursive {_VALUES}, f as (select request_id, value, base_hash, min(place) as place from v group by all),
f2 as (select *, row_number() over (partition by request_id, base_hash order by place, value) as n from f),
p as (select request_id, base_hash, max(value) as value, case place % 4 when 0 then 1 when 1 then 3 else 7 end as slot from v where place % 5 = 0 and place % 4 < 3 group by 1, 2, 4),
start as (select distinct f.request_id, f.base_hash from f),
walk as (select s.request_id, s.base_hash, 0 as n, cast(null as varchar) as value, cast(null as bigint) as place, cast(null as bigint) as slot, {_SLOTS} as held from start s left join p using (request_id, base_hash) group by 1, 2
  union all select request_id, base_hash, n, value, place, slot, list_transform(range(1, 11), lambda i: case when i = slot then value else held[i] end)
  from (select w.request_id, w.base_hash, f2.n, f2.value, f2.place, list_min(list_filter(range(1, 11), lambda i: w.held[i] is null or w.held[i] = f2.value)) as slot, w.held from walk w join f2 on w.request_id = f2.request_id and w.base_hash = f2.base_hash and f2.n = w.n + 1))
select request_id, value, base_hash, place, case when slot = 1 then base_hash else base_hash || '_' || slot end as hash, slot is null as failed from walk where n > 0""")
def carry_over(t: Tables):
    """Carried tokens take slots of their own, behind others, far ahead or nowhere; several values claim one."""
    prior = _values(t).where("place % 5 = 0").selectExpr("request_id", "value", f"{_CARRIED} as hash")
    return T.resolve_collisions(_values(t), prior)


@query(
    """with r as (select conv_id as request_id, turn, case when turn % 5 = 4 then null else repeat(text, 4) end as text from conversations)
select request_id, turn, case when text is null then 'missing_text' when length(text) > 10000 then 'text_too_long' when count(*) over (partition by request_id) > 6 then 'too_many_texts' end as reject_reason from r"""
)
def validate_request_rows(t: Tables):
    rows_ = t.conversations.select(F.col("conv_id").alias("request_id"), "turn", F.when(F.col("turn") % 5 != 4, F.repeat("text", F.lit(4))).alias("text"))
    return T.validate_requests(rows_, 6).select("request_id", "turn", "reject_reason")


_REQUEST = "case when conv_id % 5 = 0 then concat('x', conv_id) when conv_id % 3 = 0 then concat(substr(md5(concat('r', conv_id)), 1, 8), '-', substr(md5(concat('r', conv_id)), 9)) else md5(concat('r', conv_id)) end"
_PRIOR = f"select {_REQUEST} as request_id, case when conv_id % 7 = 0 then repeat(text, 40) else text end as value, case when conv_id % 11 = 0 then repeat('[#pe:abcd]', 14) else '[#pe:abcd]' end as token from conversations where turn < 6"


@query(
    f"""with r as (select {_REQUEST} as request_id, turn, text from conversations), p as ({_PRIOR}), f as (select request_id, count(*) as k, max(case when length(value) > 512 or length(token) > 128 then 1 else 0 end) as long from p group by 1),
n as (select request_id, count(*) as n from r group by 1)
select r.request_id, turn, case when r.request_id like 'x%' then 'invalid_request_id' when text is null then 'missing_text' when length(text) > 10000 then 'text_too_long' when n > 7 then 'too_many_texts'
  when k > 5 then 'too_many_carried' when long = 1 then 'carried_too_long' end as reject_reason from r join n using (request_id) left join f using (request_id)"""
)
def validate_carried_requests(t: Tables):
    """Ids that are no UUIDs, too many texts, too many carried tokens, carried values and tokens that are too long."""
    r = t.conversations.selectExpr(f"{_REQUEST} as request_id", "turn", "text")
    prior = t.conversations.where("turn < 6").selectExpr(f"{_REQUEST} as request_id", "case when conv_id % 7 = 0 then repeat(text, 40) else text end as value", "case when conv_id % 11 = 0 then repeat('[#pe:abcd]', 14) else '[#pe:abcd]' end as token")
    return T.validate_requests(r, 7, prior=prior, max_carried=5, uuids=True).select("request_id", "turn", "reject_reason")


#: Tokenisation of lines: detect, number, rewrite. No line has overlapping or adjacent spans.
TOKENIZED = f"""{LINES}, {KEYS}, {DETECTED}, v as (select f.*, l.org_id, l.request_id, {_HMAC.format(v='f.text', n=8)} as h from found f join lines l using (doc_id) join pads using (org_id)),
e as (select org_id, request_id, text as value, h, min((doc_id, "start")) as place, arg_min(pii_type, (doc_id, "start")) as pii_type from v group by 1, 2, 3, 4),
n as (select *, row_number() over (partition by org_id, request_id, h order by place, value) as n from e),
tok as (select org_id, request_id, value, pii_type, case when n = 1 then h else h || '_' || n end as hash from n),
w as (select v.doc_id, list({{'s': "start", 'e': "end", 't': '[#' || tok.pii_type || ':' || hash || ']'}} order by "start") as r from v join tok on v.org_id = tok.org_id and v.request_id = tok.request_id and v.text = tok.value group by 1)"""


@query(f"""with {TOKENIZED}, o as (select l.doc_id, l.text, r, case when r is null then text else array_to_string(list_transform(range(1, len(r) + 1),
   lambda i: substr(text, case when i = 1 then 1 else r[i - 1].e + 1 end, r[i].s - case when i = 1 then 0 else r[i - 1].e end) || r[i].t), '') || substr(text, r[-1].e + 1) end as tokenized from lines l left join w using (doc_id))
select doc_id, tokenized, cast(coalesce(len(r), 0) as bigint) as n_spans from o""")
def tokenize(t: Tables):
    return T.tokenize(lines(t), key_table(t))[0].drop("reject_reason")


@query(f"with {TOKENIZED} select org_id, request_id, hash, '[#' || pii_type || ':' || hash || ']' as token, pii_type, value from tok")
def token_entries(t: Tables):
    return T.tokenize(lines(t), key_table(t))[1]


_TURN = {"doc_id": "conv_id * 1000 + turn", "org_id": "conv_id % 6", "request_id": "conv_id", "turn": "turn", "text": "text"}
_LONG_WORD = "[a-z]{7,}"
#: Long words of conversations as values; tokens of a whole conversation by first appearance. No key for org 5.
TURNS = f"""turns as ({select(_TURN, 'conversations')}), {KEYS}, found as ({sql_find('turns', _LONG_WORD)}),
v as (select f.*, l.org_id, l.request_id, l.turn, {_HMAC.format(v='f.text', n=4)} as h from found f join turns l using (doc_id) join pads using (org_id)),
e as (select org_id, request_id, text as value, h, min((turn, "start")) as place from v group by 1, 2, 3, 4),
n as (select *, row_number() over (partition by org_id, request_id, h order by place, value) as n from e),
w as (select v.doc_id, list({{'s': "start", 'e': "end", 't': '[#org:' || n.h || case when n = 1 then '' else '_' || n end || ']'}} order by "start") as r from v join n on v.org_id = n.org_id and v.request_id = n.request_id and v.text = n.value group by 1)"""


@query(f"""with {TURNS} select l.doc_id, case when org_id = 5 then null when r is null then text else array_to_string(list_transform(range(1, len(r) + 1),
   lambda i: substr(text, case when i = 1 then 1 else r[i - 1].e + 1 end, r[i].s - case when i = 1 then 0 else r[i - 1].e end) || r[i].t), '') || substr(text, r[-1].e + 1) end as tokenized,
  cast(coalesce(len(r), 0) as bigint) as n_spans, case when org_id = 5 then 'no_key' end as reject_reason from turns l left join w using (doc_id)""")
def tokenize_turns(t: Tables):
    """Conversations tokenised in two calls, the later turns with the tokens of the first ones carried over:
    the same tokens as in one call. Orgs without a key get no text back."""
    turns = derive(t.conversations, _TURN)
    kind = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit("org").alias("pii_type"))
    turns = turns.withColumn("spans", F.transform(S.find_all(F.coalesce("text", F.lit("")), _LONG_WORD), kind))
    early, entries = T.tokenize(turns.where("turn < 3"), key_table(t), "spans", 4, turn_col="turn")
    late, _ = T.tokenize(turns.where("turn >= 3"), key_table(t), "spans", 4, entries, "turn")
    return early.unionByName(late)


@query("""with p as (select doc_id, regexp_extract_all(text, '\\b[a-zA-Z0-9][a-zA-Z0-9._%+\\-]{0,64}@[a-zA-Z0-9][a-zA-Z0-9.\\-]{0,255}\\.[a-zA-Z]{2,}\\b') as m, string_split_regex(text, '\\b[a-zA-Z0-9][a-zA-Z0-9._%+\\-]{0,64}@[a-zA-Z0-9][a-zA-Z0-9.\\-]{0,255}\\.[a-zA-Z]{2,}\\b') as g from documents)
select doc_id, cast(len(m) as bigint) as n_spans, array_to_string(list_transform(range(len(g)), lambda i: g[i + 1] || case when i < len(m) then '[#em:' || substr(sha256(unhex('""" + _pads(_DEK)[1] + """') || unhex(sha256(unhex('""" + _pads(_DEK)[0] + """') || encode(m[i + 1])))), 1, 8) || ']' else '' end), '') as tokenized from p""")
def tokenize_emails(t: Tables):
    """The flagship: emails of all documents become keyed tokens; one narrow pass, no shuffle."""
    found = t.documents.select("doc_id", "text", S.find_all(F.col("text"), P.PATTERNS[2].regex, "@").alias("r"))
    keys = T.key_pads(t.spark.range(1).select(F.lit(_DEK).cast("binary").alias("dek"))).select("ipad", "opad")
    both = found.join(F.broadcast(keys), how="cross")  # one row
    ranges = F.transform("r", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("[#em:"), T.hmac_hash(m["text"], F.col("ipad"), F.col("opad")), F.lit("]")).alias("new")))
    packed = both.select("doc_id", "text", ranges.alias("r"))
    return packed.select("doc_id", F.size("r").cast("long").alias("n_spans"), S.replace_ranges(F.col("text"), F.col("r"), lambda x: x["new"]).alias("tokenized"))


@query(f"""with {LINES}, {DETECTED}, n as (select doc_id, count(*) as n, sum("end" - "start") as chars from found group by 1), k as (select doc_id, string_agg(pii_type || '=' || k, ',' order by pii_type) as types from (select doc_id, pii_type, count(*) as k from found group by 1, 2) group by 1)
select doc_id, cast(coalesce(n, 0) as integer) as n_regex, 0 as n_model, cast(coalesce(n, 0) as integer) as n_spans, cast(coalesce(chars, 0) as bigint) as chars, coalesce(types, '') as types from lines left join n using (doc_id) left join k using (doc_id)""")
def detection_profile_documents(t: Tables):
    out = D.document_profile(D.detect(lines(t)))
    return out.withColumn("types", F.array_join(F.transform("types", lambda x: F.concat(x["pii_type"], F.lit("="), x["n"].cast("string"))), ","))


@query(f"with {LINES} select doc_id, text from lines")
def rehydrate(t: Tables):
    """Tokenise, encrypt, then put every value back: the lines themselves."""
    keys = key_table(t)
    docs, entries = T.tokenize(lines(t), keys)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    vault = T.encrypt_values(entries, keys, now)
    named = docs.join(lines(t).select("doc_id", "org_id", "request_id"), "doc_id").select("doc_id", "org_id", "request_id", F.col("tokenized").alias("text"))
    return T.rehydrate(named, vault, keys, now).select("doc_id", "text")


# ---- vault: rows derived from events

VROW = {
    "org_id": "user_id % 7",
    "request_id": "user_id % 30",
    "token_hash": "concat('h', cast(event_id % 400 as string))",
    "encrypted": "event_id",
    "created_at": "ts",
    "expires_at": "ts + interval '10' day",
}
VROWS = f"v as ({select(VROW, 'events')}), nv as (select * from v qualify row_number() over (partition by org_id, request_id, token_hash order by created_at desc, expires_at desc, encrypted desc) = 1), live as (select * from nv where expires_at > timestamp '2024-01-31 00:00:00')"


def vault(t: Tables):
    return derive(t.events, VROW)


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@query(f"with {VROWS} select org_id, request_id, token_hash, encrypted from nv")
def vault_upsert(t: Tables):
    half = vault(t)
    return V.upsert(half.where("encrypted % 2 = 0"), half.where("encrypted % 2 = 1")).select(*V.KEY, "encrypted")


_ASKED = "asked as (select distinct user_id % 8 as org_id, user_id % 30 as request_id, concat('h', event_id % 400) as token_hash from events where event_type = 'view')"


def _asked(t: Tables):
    return t.events.where("event_type = 'view'").selectExpr("user_id % 8 as org_id", "user_id % 30 as request_id", "concat('h', event_id % 400) as token_hash").distinct()


@query(f"with {VROWS}, {_ASKED} select a.*, encrypted from asked a left join live using (org_id, request_id, token_hash)")
def vault_lookup(t: Tables):
    return V.lookup(_asked(t), vault(t), now())


@query(f"with {VROWS}, q as (select distinct user_id % 9 as org_id, user_id % 30 as request_id from events where event_type = 'error'), c as (select org_id, request_id, count(*) as n from nv group by all) select q.*, coalesce(n, 0) as n_removed from q left join c using (org_id, request_id)")
def vault_flush(t: Tables):
    asked = t.events.where("event_type = 'error'").selectExpr("user_id % 9 as org_id", "user_id % 30 as request_id")
    return V.flush(vault(t), asked)[1]


@query(f"with {VROWS} select distinct org_id, request_id, token_hash from live")
def vault_active_pairs(t: Tables):
    return V.active_pairs(vault(t), now())


@query(f"with {VROWS} select org_id, count(*) as n_active from live group by org_id")
def vault_org_counts(t: Tables):
    return V.org_counts(vault(t), now())


@query(f"with {VROWS}, {_ASKED} select a.*, coalesce(cast(floor(epoch(expires_at)) - epoch(timestamp '2024-01-31 00:00:00') as bigint), -2) as ttl from asked a left join live using (org_id, request_id, token_hash)")
def vault_ttl(t: Tables):
    return V.ttl(_asked(t), vault(t), now())


@query(f"with {VROWS} select org_id, request_id, token_hash, encrypted from v where expires_at > timestamp '2024-01-31 00:00:00'")
def vault_purge(t: Tables):
    return V.purge(vault(t), now()).select(*V.KEY, "encrypted")


@query(f"with {VROWS}, c as (select org_id, count(*) as n from live group by org_id) select o.org_id, coalesce(n, 0) as n_active, case when coalesce(n, 0) >= 400 then 'token_quota_exceeded' end as reject_reason from (select distinct user_id % 9 as org_id from events) o left join c using (org_id)")
def org_token_quota(t: Tables):
    return V.quota(t.events.select((F.col("user_id") % 9).alias("org_id")), vault(t), now(), 400)


@query(f"with {VROWS} select org_id, request_id, token_hash, cast(encrypted as varchar) as value from live where org_id <> 3")
def rotate_keys(t: Tables):
    """Encrypt, rotate to new keys (one org has none), decrypt with the new ones: the live values."""
    old = t.events.select((F.col("user_id") % 7).alias("org_id")).distinct().withColumn("dek", F.unhex(F.rpad(F.hex(F.concat(F.lit("old"), F.col("org_id").cast("string")).cast("binary")), 64, "0")))
    new = old.where("org_id <> 3").withColumn("dek", F.unhex(F.rpad(F.hex(F.concat(F.lit("new"), F.col("org_id").cast("string")).cast("binary")), 64, "0")))
    aad = F.col("org_id").cast("string").cast("binary")
    sealed = vault(t).join(old, "org_id").withColumn("encrypted", F.aes_encrypt(F.col("encrypted").cast("string").cast("binary"), "dek", F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)).drop("dek")
    turned = V.rotate_keys(V.newest(vault(t)).select(*V.KEY, "created_at").join(sealed, [*V.KEY, "created_at"]), old, new, now()).join(new, "org_id")
    return turned.select(*V.KEY, T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).alias("value"))
