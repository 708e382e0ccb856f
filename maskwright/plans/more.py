"""Queries of the remaining token, annotation and source operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.frames import shared_folder
from maskwright.functions.patterns import EMAIL, PATTERNS
from maskwright.functions.tables import register
from maskwright.operators import detect as D
from maskwright.operators import tokens as T
from maskwright.operators import vault as V
from maskwright.plans.corpora import ENTITIES, examples
from maskwright.plans.detection import BASE, LINES, SPANS, key_table, lines, overlapping, rows, sql_find, token_text
from maskwright.plans.registry import ORACLES, Tables, query
from maskwright.sources import corpora as R


def _now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@query(f"with e as ({sql_find('documents', EMAIL)}) select text as value, min(doc_id) as doc_id, count(*) as n from e group by 1")
def dedupe_values(t: Tables):
    """Distinct values with the document of their first occurrence."""
    long = t.documents.select("doc_id", F.explode_outer(S.find_all(F.col("text"), PATTERNS[2].regex, "@")).alias("s")).where("s is not null")
    return long.groupBy(F.col("s.text").alias("value")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, regexp_replace(text, '{EMAIL}', '<mail>', 'g') as text from documents")
def replace_spans(t: Tables):
    found = t.documents.select("doc_id", "text", S.find_all(F.col("text"), PATTERNS[2].regex, "@").alias("r"))
    return found.select("doc_id", S.replace_ranges(F.col("text"), F.col("r"), lambda x: F.lit("<mail>")).alias("text"))


@query("select c_custkey as org_key, c_name as value from customer")
def encrypt_values(t: Tables):
    """Encrypt each name under its org's key and decrypt it again; a wrong org gives null and is left out."""
    keys = key_table(t)
    rows = t.customer.select((F.col("c_nationkey") % 5).alias("org_id"), F.col("c_custkey").alias("request_id"), F.lit("h").alias("hash"), F.col("c_name").alias("value"))
    sealed = T.encrypt_values(rows, keys, _now()).join(keys.select("org_id", "dek"), "org_id")
    both = sealed.select(F.col("request_id").alias("org_key"), T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).alias("value"), T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id") + 1).alias("other"))
    return both.where("other is null").select("org_key", "value")


@query("select s_suppkey as org_id, concat('dek-', min(s_name)) as dek from supplier where s_suppkey % 3 <> 0 group by 1")
def wrap_keys(t: Tables):
    """Keys of orgs that have none, wrapped under the key-encrypting key and unwrapped again."""
    kek = t.region.limit(1).select(F.unhex(F.lit("01" * 32)).alias("kek"))
    orgs = t.supplier.select(F.col("s_suppkey").alias("org_id"), F.concat(F.lit("dek-"), "s_name").cast("binary").alias("dek"), F.lit(1).alias("created_at"))
    late = orgs.withColumn("created_at", F.lit(2)).withColumn("dek", F.lit("late").cast("binary"))
    wrapped = T.wrap_keys(orgs.unionByName(late), orgs.where("org_id % 3 = 0"), kek)
    return wrapped.join(F.broadcast(kek), how="cross").select("org_id", F.aes_decrypt("encrypted_dek", "kek", F.lit("GCM")).cast("string").alias("dek"))  # one row


_SCOPED = "v as (select c_custkey % 5 as org_id, c_custkey // 5 % 8 as request_id, 'h' || (c_custkey // 40) as hash, c_custkey, c_name as value from customer)"


@query(f"""with {_SCOPED}, a as (select c_custkey as asked, org_id + c_custkey % 2 as org_id, request_id + case when c_custkey % 3 = 0 then 1 else 0 end as request_id, hash from v)
select asked, org_id, request_id, value from a join v using (org_id, request_id, hash)""")
def scope_isolation(t: Tables):
    """One hash stands for other values under other orgs and requests: a lookup finds that of its own scope or nothing."""
    k = F.col("c_custkey")
    rows = t.customer.select((k % 5).alias("org_id"), (F.floor(k / 5) % 8).alias("request_id"), F.concat(F.lit("h"), F.floor(k / 40).cast("string")).alias("hash"), "c_custkey", F.col("c_name").alias("value"))
    keys = key_table(t)
    vault = T.encrypt_values(rows, keys, _now())
    asked = rows.select(k.alias("asked"), (F.col("org_id") + k % 2).alias("org_id"), (F.col("request_id") + F.when(k % 3 == 0, 1).otherwise(0)).alias("request_id"), F.col("hash").alias("token_hash"))
    found = V.lookup(asked.select(*V.KEY).distinct(), vault, _now()).where("encrypted is not null").join(keys.select("org_id", "dek"), "org_id")
    shown = found.select(*V.KEY, T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).alias("value"))
    return asked.join(shown, V.KEY).select("asked", "org_id", "request_id", "value")


@query(f"with {LINES} select doc_id, kind, 'ABo ' || text || ' ceX' as folded, length(text) + 8 as n from lines where length(text) > 0")
def fold_keeps_length(t: Tables):
    """Lines between look-alike letters (Greek and Cyrillic): plain letters, one for one."""
    made = lines(t).select("doc_id", "kind", F.concat(F.lit("\u0391\u0412\u043e "), "text", F.lit(" \u0441\u0435\u03a7")).alias("made"))
    return made.select("doc_id", "kind", S.fold_confusables(F.col("made")).alias("folded"), F.length("made").cast("long").alias("n"))


@query(f'with {SPANS}, {BASE} select doc_id, s."start" as "start", s."end" as "end", s.pii_type as pii_type, substr(text, s."start" + 1, s."end" - s."start") as text, 0.85::double as confidence from spans s join base using (doc_id) where s.source = \'slm\'')
def model_spans(t: Tables):
    """Model spans get their text, source and confidence; these spans have no outer punctuation to trim."""
    text = F.translate("text", ".-+", "abc")
    own = overlapping(t).select("doc_id", "text", text.alias("plain"), F.transform(F.filter("spans", lambda s: s["source"] == "slm"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["pii_type"].alias("pii_type"))).alias("l"))
    made = own.select("doc_id", F.col("text").alias("doc"), D.model_spans(F.col("l"), F.regexp_replace("plain", "[^a-z]", "q")).alias("spans"))
    long = made.select("doc_id", "doc", F.explode_outer("spans").alias("s")).where("s is not null")
    return long.select("doc_id", "s.start", "s.end", "s.pii_type", F.expr("substring(doc, s.start + 1, s.end - s.start)").alias("text"), "s.confidence")


@query(f"with {ENTITIES} select doc_id, i, text, case doc_id % 3 when 0 then 'span_labels' when 1 then 'privacy_mask' else 'bio' end as layout from ent")
def layout_coalesce(t: Tables):
    """Span labels, else the privacy mask, else the token columns: the first that gives entities."""
    k = F.col("doc_id") % 3
    e = F.transform("entities", lambda x: x["text"])
    none = F.array().cast("array<string>")
    rows = examples(t).select("doc_id", F.when(k == 0, e).otherwise(none).alias("span_labels"), F.when(k <= 1, e).otherwise(none).alias("privacy_mask"), e.alias("bio"))
    picked = rows.select("doc_id", R.first_layout(["span_labels", "privacy_mask", "bio"]).alias("x"))
    return picked.select("doc_id", F.col("x.layout").alias("layout"), F.posexplode_outer("x.entities").alias("i", "text"))


@query("""select doc_id, text, false as malformed from documents where doc_id % 10 <> 0
union all select null, '{"doc_id": 1, "text": "', true from documents where doc_id % 10 = 0""")
def read_jsonl_tolerant(t: Tables):
    """Documents as JSON lines, every tenth cut short: what can be read comes back, the rest is set apart."""
    folder = shared_folder(t.spark)
    line = F.to_json(F.struct("doc_id", "text"))
    broken = t.documents.select(F.when(F.col("doc_id") % 10 == 0, F.expr("substring(text, 1, 0) || '{\"doc_id\": 1, \"text\": \"'")).otherwise(line).alias("value"))
    broken.write.text(folder)
    good, bad = R.read_jsonl(t.spark, folder, "doc_id long, text string")
    good = good.select("doc_id", "text", F.lit(False).alias("malformed"))
    return good.unionByName(bad.select(F.lit(None).cast("long").alias("doc_id"), F.col("line").alias("text"), F.lit(True).alias("malformed")))


@query(
    """with c as (select source as _source, count(*) filter (doc_id % 10 <> 0) as rows, count(*) filter (doc_id % 10 = 0) as malformed, count(*) filter (doc_id % 10 = 1) as blank, cast(sum(length(text)) filter (doc_id % 10 <> 0) as bigint) as n_chars
  from documents group by 1)
select c.*, sum(rows) over () = max(r) over () and sum(malformed) over () = max(m) over () and sum(blank) over () = max(b) over () as observed
from c, (select count(*) filter (doc_id % 10 <> 0) as r, count(*) filter (doc_id % 10 = 0) as m, count(*) filter (doc_id % 10 = 1) as b from documents)"""
)
def import_jsonl(t: Tables):
    """Documents as a tree of JSON lines, every tenth without its end and an empty line behind every tenth, imported
    in one pass: lines by kind and characters of the rows, and whether the counts taken while writing are their sums."""
    folder = shared_folder(t.spark)
    line = F.to_json(F.struct("doc_id", "text"))
    value = F.when(F.col("doc_id") % 10 == 0, F.expr("left(l, length(l) - 1)")).when(F.col("doc_id") % 10 == 1, F.concat("l", F.lit("\n  "))).otherwise(F.col("l"))
    t.documents.select("source", line.alias("l"), "doc_id").select("source", value.alias("value")).write.partitionBy("source").text(folder)
    source = F.regexp_extract(F.col("_metadata.file_path"), "/source=([^/]*)/", 1)
    table, seen = R.import_jsonl(t.spark, [folder], shared_folder(t.spark), "doc_id long, text string", source, "*.txt")
    sizes = table.where("_kind = 'row'").groupBy("_source").agg(F.sum(F.length("text")).alias("n_chars"))
    counts = R.line_counts(table).join(sizes, "_source", "left")
    whole = Window.partitionBy()  # one row a source
    same = [F.sum(c).over(whole) == F.lit(n) for c, n in seen.items()]
    return counts.withColumn("observed", same[0] & same[1] & same[2])


@query("select source as _source, doc_id, lang from documents")
def write_corpus(t: Tables):
    """Documents written as one JSON folder a source and read back."""
    folder = shared_folder(t.spark)
    R.write_corpus(t.documents.select(F.col("source").alias("_source"), "doc_id", "lang"), folder)
    return t.spark.read.schema("doc_id long, lang string, _source_label string, _source string").json(folder).select("_source", "doc_id", "lang")


@query("select doc_id, case doc_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, len(string_split(text, ' ')) as n from documents")
def write_labels_columnar(t: Tables):
    folder = shared_folder(t.spark)
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test")
    R.write_labels(t.documents.select("doc_id", split.alias("split"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("labels")), folder)
    return t.spark.read.parquet(folder).select("doc_id", "split", F.size("labels").cast("long").alias("n"))


@query("select source as _source, doc_id, text from documents")
def read_jsonl_tree(t: Tables):
    """Documents as a tree of JSON lines, files named after their source, read by walking the tree."""
    folder = shared_folder(t.spark)
    lines_ = t.documents.select("source", F.to_json(F.struct("doc_id", "text")).alias("value"))
    lines_.write.partitionBy("source").text(folder)
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    for source in fs.globStatus(path(f"{folder}/source=*")):
        for i, file in enumerate(fs.globStatus(path(source.getPath(), "part-*"))):
            inner = path(source.getPath(), str(i))
            fs.mkdirs(inner)
            fs.rename(file.getPath(), path(inner, source.getPath().getName().removeprefix("source=") + ".jsonl"))
    return R.read_jsonl_tree(t.spark, [folder], "doc_id long, text string").select("_source", "doc_id", "text")


@query(ORACLES["find_tokens"].replace('select doc_id, "start"', "select doc_id, regexp_extract(text, '#([a-z]+)', 1) as pii_type, regexp_extract(text, ':([a-f0-9_]+)', 1) as hash, \"start\"", 1).replace('"end", text from (', '"end" from (', 1))
def find_tokens_table(t: Tables):
    """Tokens as rows of the table function under LATERAL."""
    register(t.spark)
    texts = t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("a "), token_text(), F.lit(" b "), token_text()).alias("text"))
    return t.spark.sql("select x.doc_id, s.start, s.`end`, s.pii_type, s.hash from {texts} x, lateral find_tokens(x.text) s", texts=texts)


def _placed(t: Tables):
    return t.documents.select("doc_id", (F.col("doc_id") % 5).alias("org_id"), F.col("source").alias("request_id"), "text")


@query()
def detect_documents(t: Tables):
    """All patterns over the whole texts; their look-around is not SQL, so a test holds them against brute force."""
    return rows(D.detect(t.documents.select("doc_id", "text")))


@query("select doc_id, text from documents")
def rehydrate_documents(t: Tables):
    """Every kind of value of the whole texts tokenised, encrypted and put back: the texts themselves."""
    keys, docs = key_table(t), _placed(t)
    made, entries = T.tokenize(docs, keys)
    vault = T.encrypt_values(entries, keys, _now())
    named = made.select("doc_id", (F.col("doc_id") % 5).alias("org_id"), F.col("tokenized").alias("text")).join(docs.select("doc_id", "request_id"), "doc_id")
    return T.rehydrate(named, vault, keys, _now()).select("doc_id", "text")
