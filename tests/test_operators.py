"""Behaviour of the operators on small cases."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.patterns import PATTERNS
from maskwright.functions.tables import register
from maskwright.operators import corpus as C
from maskwright.operators import detect as D
from maskwright.operators import evaluate as E
from maskwright.operators import tokens as T
from maskwright.operators import vault as V
from maskwright.sources import corpora as R


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def found(df):
    return {(r["doc_id"], s["pii_type"], s["text"]) for r in df.collect() for s in r["spans"]}


def test_detect_kinds_and_nulls(spark):
    df = texts(spark, "CF RSSMRA80A01H501Z", None, "", "scrivi a a.b@example.org entro il 02/03/2021", "😀 tel +39 320 1234567.", "P IVA 01234567890")
    assert found(D.detect(df)) == {
        (0, "cf", "RSSMRA80A01H501Z"), (3, "em", "a.b@example.org"), (3, "dt", "02/03/2021"), (4, "tel", "+39 320 1234567"), (5, "fin", "01234567890"),
    }


def test_guards_hold_for_shortest_matches(spark):
    least = ["RSSMRA80A01H501Z", "DE12ABCDEFGHIJ", "a@b.co", "01234567890", "3201234567", "1/1/2001", "3 mag", "3 Jan", "12345678901"]
    assert len(least) == len(PATTERNS)
    for text, p in zip(least, PATTERNS, strict=True):
        row = spark.range(1).select(F.lit(text).rlike(p.regex), F.lit(text).rlike(p.guard or "")).first()
        assert all(row), (text, p)
    assert found(D.detect(texts(spark, "nato il 5 marzo, residente"))) == {(0, "dt", "5 marzo")}
    other = {"cf": "RSSMRA80A01H٥٠١Z", "ib": "DE٨٩ABCDEFGHIJ", "fin": "0١٢٣٤٥٦٧٨٩٠"}  # digits of another script
    for p in (PATTERNS[0], PATTERNS[1], PATTERNS[3], PATTERNS[8]):
        text = {0: other["cf"], 1: other["ib"], 3: other["fin"], 8: "1" + other["fin"][1:]}[PATTERNS.index(p)]
        assert all(spark.range(1).select(F.lit(text).rlike(p.regex), F.lit(text).rlike(p.guard)).first()), text


def test_offsets_are_code_points(spark):
    row = D.detect(texts(spark, "😀é a.b@example.org")).first()
    s = row["spans"][0]
    assert row["text"][s["start"] : s["end"]] == s["text"] == "a.b@example.org"


def test_look_alikes_keep_the_original_text(spark):
    assert found(D.detect(texts(spark, "cf RSSМRА80A01H501Z"))) == {(0, "cf", "RSSМRА80A01H501Z")}


def test_protected_text_is_left_alone(spark):
    df = texts(spark, "[#em:1234abcd] <user_context x>a.b@example.org</user_context> c.d@example.org")
    assert found(D.detect(df)) == {(0, "em", "c.d@example.org")}


@pytest.mark.parametrize(
    ("text", "start", "end", "left"),
    [("(Rossi),", 1, 8, "Rossi"), ("S.r.l.", 0, 6, "S.r.l."), ("dott.", 0, 5, "dott."), ("Colombo.", 0, 8, "Colombo"), ("D'Amico", 0, 7, "D'Amico"), ("Mario's", 0, 7, "Mario"), ("Neri (capo)", 0, 11, "Neri (capo)"), ("?!,", 0, 3, ""), ('"Bianchi"', 0, 9, "Bianchi")],
)
def test_trim(spark, text, start, end, left):
    x = spark.createDataFrame([(text, start, end)], "t string, s int, e int").select(S.trim_punctuation(F.col("s"), F.col("e"), F.col("t")).alias("x")).first()["x"]
    assert text[x["start"] : max(x["start"], x["end"])] == left


def test_hmac_is_the_standard_one(spark):
    keys = T.key_pads(spark.createDataFrame([(bytearray(b"k" * 32),)], "dek binary"))
    got = keys.select(T.hmac_hash(F.lit("valore"), F.col("ipad"), F.col("opad"))).first()[0]
    assert got == hmac.new(b"k" * 32, b"valore", hashlib.sha256).hexdigest()[:8]


def setting(spark):
    docs = spark.createDataFrame([(1, 1, "r1", "a@x.org e b@x.org e a@x.org"), (2, 2, "r1", "a@x.org"), (3, 1, "r2", None), (4, 1, "r2", "niente")], "doc_id long, org_id long, request_id string, text string")
    keys = T.key_pads(spark.createDataFrame([(1, bytearray(b"1" * 32)), (2, bytearray(b"2" * 32))], "org_id long, dek binary"))
    return docs, keys


def test_tokenize_and_rehydrate(spark):
    docs, keys = setting(spark)
    out, entries = T.tokenize(docs, keys)
    got = {r["doc_id"]: r["tokenized"] for r in out.collect()}
    assert "@" not in got[1] and got[1].count("[#em:") == 3 and len(set(got[1].split(" e "))) == 2
    assert got[4] == "niente" and got[3] is None
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    vault = T.encrypt_values(entries, keys, now).cache()
    assert vault.count() == 3
    named = out.join(docs.drop("text"), "doc_id").withColumnRenamed("tokenized", "text")
    back = {r["doc_id"]: (r["text"], r["n_restored"]) for r in T.rehydrate(named, vault, keys, now).collect()}
    assert back[1] == ("a@x.org e b@x.org e a@x.org", 3) and back[2] == ("a@x.org", 1) and back[4] == ("niente", 0)
    late = F.lit("2024-01-01 01:00:00").cast("timestamp")
    assert {r["text"] for r in T.rehydrate(named, vault, keys, late).where("doc_id = 1").collect()} == {got[1]}
    # tokens of one org mean nothing under another
    moved = named.where("doc_id = 1").withColumn("org_id", F.lit(2).cast("long"))
    assert T.rehydrate(moved, vault, keys, now).first()["n_restored"] <= 2
    again, _ = T.tokenize(named, keys)
    assert {r["doc_id"]: r["n_spans"] for r in again.collect()}[1] == 0


def test_tokens_of_repeated_ids_and_null_requests(spark):
    rows = [(1, 1, None, "a@x.org"), (1, 1, None, "b@x.org e a@x.org"), (1, 1, None, "niente"), (None, 1, "r", "a@x.org"), (5, 9, "r", "senza chiave c@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, org_id long, request_id string, text string")
    _, keys = setting(spark)
    out, entries = T.tokenize(docs, keys)
    got = sorted((r["tokenized"] or "", r["n_spans"], r["reject_reason"] or "") for r in out.collect())
    assert len(got) == 5 and [n for _, n, _ in got] == [0, 1, 1, 2, 0]
    assert [(t, why) for t, _, why in got if "[#" not in t] == [("", "no_key"), ("niente", "")]  # no key: no text
    assert {(r["request_id"], r["value"]) for r in entries.collect()} == {(None, "a@x.org"), (None, "b@x.org"), ("r", "a@x.org")}
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    vault = T.encrypt_values(entries, keys, now).checkpoint()
    texts_ = out.where("doc_id = 1").select("doc_id", F.lit(1).cast("long").alias("org_id"), F.lit(None).cast("string").alias("request_id"), F.concat("tokenized", F.lit(" [#em:00000000]")).alias("text"))
    back = {(r["text"], r["n_restored"]) for r in T.rehydrate(texts_, vault, keys, now).collect()}
    assert back == {(f"{t} [#em:00000000]", n) for t, n in (("a@x.org", 1), ("b@x.org e a@x.org", 2), ("niente", 0))}


def test_rotation_and_isolation(spark):
    docs, keys = setting(spark)
    _, entries = T.tokenize(docs, keys)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    vault = T.encrypt_values(entries, keys, now).cache()
    new = spark.createDataFrame([(1, bytearray(b"9" * 32))], "org_id long, dek binary")
    turned = V.rotate_keys(vault, keys.select("org_id", "dek"), new, now).cache()
    assert turned.count() == 2
    assert turned.join(new, "org_id").where(T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).isNull()).count() == 0
    assert turned.join(keys, "org_id").where(T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).isNotNull()).count() == 0
    kek = spark.createDataFrame([(bytearray(b"\x01" * 32),)], "kek binary")
    orgs = keys.select("org_id", "dek", F.lit(1).alias("created_at"))
    assert {r["org_id"] for r in T.wrap_keys(orgs, new.select("org_id"), kek).collect()} == {2}


def test_collisions_beyond_the_limit_fail(spark):
    v = spark.createDataFrame([("r", f"v{i:02d}", "abcd", i) for i in range(12)], "request_id string, value string, base_hash string, place int")
    got = [r["hash"] for r in T.resolve_collisions(v).orderBy("place").collect()]
    assert got[:3] == ["abcd", "abcd_2", "abcd_3"] and got[9] == "abcd_10" and got[10:] == [None, None]


def test_fold_modes(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["B-pe", "I-org", "I-pe"]), (["a"], ["I-pe"]), (None, ["O"]), (["a"], [])], "t array<string>, y array<string>")
    got = lambda mode: [None if r[0] is None else [(x["type"], x["start"], x["end"]) for x in r[0]] for r in df.select(C.fold_labels(F.col("t"), F.col("y"), mode)).collect()]
    assert got("drop") == [[("pe", 0, 1)], [], None, None]
    assert got("extend") == [[("pe", 0, 5)], [], None, None]
    assert got("open") == [[("pe", 0, 1), ("org", 2, 3), ("pe", 4, 5)], [("pe", 0, 1)], None, None]


def plain_fold(words, tags, stray, text):
    """One token after the other."""
    if words is None or tags is None or not words or len(words) != len(tags):
        return None
    out, pos, open_ = [], 0, None
    for word, tag in zip(words, tags, strict=True):
        at = pos if text is None else -1 if word is None else text.find(word, pos)
        long = len(word or "")
        tag = "O" if at < 0 or tag is None else tag
        if open_ and tag[:2] == "I-" and (stray == "extend" or tag[2:] == open_[0]):
            open_[2] = at + long
        else:
            if open_:
                out.append(tuple(open_))
            open_ = [tag[2:], at, at + long] if tag[:2] == "B-" or (tag[:2] == "I-" and stray == "open") else None
        if at >= 0:
            pos = at + long + (text is None)
    return out + [tuple(open_)] if open_ else out


def test_fold_equals_one_token_after_the_other(spark):
    rng = random.Random(3)
    rows = [(None, ["O"], None), ([], [], None), (["a"], None, "a"), ([None, "b"], [None, "B-pe"], None), ([None, "b"], ["B-pe", "I-pe"], "a b")]
    for _ in range(700):
        words = [rng.choice(["a", "bé", "😀c", ""]) for _ in range(rng.randrange(1, 9))]
        tags = [rng.choice(["O", "B-pe", "I-pe", "B-org", "I-org"]) for _ in range(len(words) + (rng.random() < 0.05))]
        text = "  ".join(w for w in words if rng.random() < 0.8)
        rows.append((words, tags, text if rng.random() < 0.5 else None))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t array<string>, y array<string>, x string")
    for stray in ("drop", "extend", "open"):
        made = df.select("i", C.fold_labels(F.col("t"), F.col("y"), stray, F.col("x")).alias("s"))
        got = {r["i"]: None if r["s"] is None else [tuple(s) for s in r["s"]] for r in made.collect()}
        for i, (words, tags, text) in enumerate(rows):
            assert got[i] == plain_fold(words, tags, stray, text), (stray, words, tags, text)
    assert df.limit(0).select(C.fold_labels(F.col("t"), F.col("y"))).count() == 0


def test_alignment_in_the_source_text(spark):
    df = spark.createDataFrame([("Anna  Neri, a Pisa", ["Anna", "Neri", "zz", "Pisa"], ["B-PER", "I-PER", "I-PER", "B-LOC"])], "text string, t array<string>, y array<string>")
    x = df.select(C.fold_labels(F.col("t"), F.col("y"), "extend", F.col("text"))).first()[0]
    assert [(s["type"], s["start"], s["end"]) for s in x] == [("PER", 0, 10), ("LOC", 14, 18)]


def test_sources(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "one.jsonl").write_text('{"text": "x", "entities": []}\n\n{"text": broken\n{"text": "è", "entities": [{"t": "è", "y": "pe", "s": 0, "e": 1}]}\n')
    good, bad = R.read_jsonl(spark, str(folder))
    assert good.count() == 2 and bad.count() == 1
    tree = R.read_jsonl_tree(spark, [str(tmp_path / "a")])
    assert {(r["text"], r["_source"]) for r in tree.collect()} == {("x", "one"), ("è", "one")}
    assert good.select(R.normalize_keys(F.col("entities")).alias("e")).where("size(e) = 1").first()["e"][0]["type"] == "pe"
    R.write_corpus(tree, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").rglob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 2 and all(x["_source_label"] == "one" for x in lines)
    R.write_labels(spark.createDataFrame([("train", [1]), ("val", [2])], "split string, labels array<int>"), str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 2


def test_find_tokens_table_function(spark):
    register(spark)
    rows = spark.sql("select t.* from values ('a [#em:1234abcd] [#zz:1234]') as v(text), lateral find_tokens(v.text) t").collect()
    assert [(r["start"], r["end"], r["pii_type"]) for r in rows] == [(2, 16, "em")]


def test_partial_needs_more_than_half_but_confusion_only_half(spark):
    schema = "doc_id long, type string, start int, end int"
    gold = spark.createDataFrame([(1, "pe", 0, 4)], schema)
    pred = spark.createDataFrame([(1, "pe", 0, 2), (1, "org", 0, 8)], schema)
    assert E.match_partial(gold, pred).first().asDict() == {"tp": 0, "fp": 2, "fn": 1}
    got = {(r["gold_type"], r["pred_type"]): r["n"] for r in E.confusion_matrix(gold, pred).collect()}
    assert got == {("pe", "pe"): 1, ("SPURIOUS", "org"): 1}


def test_empty_inputs(spark):
    schema = "doc_id long, type string, start int, end int"
    none = spark.createDataFrame([], schema)
    assert E.prf(E.match_exact(none, none)).first()["f1"] == 0
    assert E.match_partial(none, none).first()["tp"] == 0


def test_stream_of_requests_remembers_over_triggers(spark, tmp_path):
    """Texts of requests in three triggers, all patterns: the tokens of one batch call."""
    from maskwright.plans.detection import key_table, lines
    from maskwright.plans.registry import Tables
    from maskwright.streaming import jobs as J
    from compare import DATA

    t = Tables(spark, DATA)
    docs = lines(t).where("doc_id < 120").select("doc_id", "org_id", (F.col("doc_id") % 4).alias("request_id"), F.col("doc_id").alias("turn"), "text").checkpoint()
    for k in range(3):
        docs.where(F.floor(F.col("doc_id") / 40) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keys = key_table(t).where("org_id <> 2")
    got = sorted(map(tuple, J.drain(J.tokenize_requests(stream, keys)).collect()))
    want = sorted(map(tuple, T.tokenize(docs, keys)[0].select("doc_id", "tokenized", "n_spans", "reject_reason").collect()))
    assert got == want and any("[#" in (r[1] or "") for r in got) and any(r[3] == "no_key" for r in got)


@pytest.mark.parametrize("one_file", [True, False])
def test_streams_of_a_file_and_of_a_folder(spark, tmp_path, one_file):
    from maskwright.plans.all import QUERIES

    docs = spark.createDataFrame([(i, f"a{i}@example.org") for i in range(6)], "doc_id long, text string")
    table = tmp_path / "documents.parquet"
    docs.repartition(1 if one_file else 3).write.parquet(str(table))
    if one_file:
        table = table.rename(tmp_path / "written")
        next(table.glob("part-*")).rename(tmp_path / "documents.parquet")
    assert sorted((r["doc_id"], r["n_spans"]) for r in QUERIES["stream_tokenize"](spark, str(tmp_path)).collect()) == [(i, 1) for i in range(6)]


def test_stream_of_turns_in_a_folder_of_files(spark, tmp_path):
    from maskwright.plans.all import QUERIES

    data = "/root/testdata/sf0.001"
    (tmp_path / "nation.parquet").symlink_to(f"{data}/nation.parquet")
    spark.read.parquet(f"{data}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = lambda folder: sorted(map(str, QUERIES["stream_tokenize_turns"](spark, str(folder)).collect()))
    assert rows(tmp_path) == rows(data) != []


def test_stream_of_requests_takes_rows_without_turn(spark, tmp_path):
    from maskwright.plans.detection import key_table
    from maskwright.plans.registry import Tables
    from maskwright.streaming import jobs as J
    from compare import DATA

    rows = [(1, 1, 1, 0, "a@example.org"), (None, 1, 1, None, "b@example.org"), (3, 1, 1, None, "a@example.org")]
    docs = spark.createDataFrame(rows, "doc_id long, org_id long, request_id long, turn long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = J.drain(J.tokenize_requests(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), key_table(Tables(spark, DATA)))).collect()
    token = {r["doc_id"]: r["tokenized"] for r in got}
    assert len(got) == 3 and token[1] == token[3] != token[None] and all("[#em:" in t for t in token.values())


def test_stream_slots_run_out(spark, tmp_path):
    """Eleven values of one hash: ten tokens, then a text without one comes back null."""
    from maskwright.streaming import jobs as J

    keys = T.key_pads(spark.createDataFrame([(1, bytearray(b"1" * 32))], "org_id long, dek binary"))
    span = "array<struct<start:int,end:int,text:string,pii_type:string>>"
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("org_id"), F.lit(5).cast("long").alias("request_id"), F.col("id").alias("turn"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("text"))
    docs = docs.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), "text", F.lit("pe").alias("pii_type"))).cast(span))
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = J.drain(J.tokenize_requests(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), keys.withColumn("ipad", F.lit(b"x")).withColumn("opad", F.lit(b"y")), "spans", 0)).collect()
    assert all(r["tokenized"] is None and r["reject_reason"] == "no_token" for r in got)  # an empty hash is no token's


def test_parallel_quota_equals_the_fold(spark):
    """Limits that are crossed early, late and never, small and empty calls behind, groups without a name."""
    from maskwright.operators import metering

    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, 1, 2, 3, 4]), f"2024-0{rnd.randint(1, 2)}-{rnd.randint(1, 28):02d} {rnd.randint(0, 23):02d}:00:0{rnd.randint(0, 2)}", rnd.choice([None, 0, 1, 2, 5, 40, 90])) for i in range(4000)]
    calls = spark.createDataFrame(rows, "event_id long, org_id long, ts string, tokens int").withColumn("ts", F.to_timestamp("ts"))
    plan = spark.createDataFrame([(1, 500), (2, 13), (3, -1), (4, 10**9)], "org_id long, monthly_token_limit int")
    got = sorted(map(str, metering.monthly_quota(calls, plan).collect()))
    caps = {1: 500, 2: 13, 3: -1, 4: 10**9, None: metering.PLANS[0][3]}
    folded = metering.running_quota(calls.withColumn("cap", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in caps.items() if k for x in (k, v))), F.coalesce(F.col("org_id").cast("int"), F.lit(0))), F.lit(caps[None]))))
    assert got == sorted(map(str, folded.select("event_id", "org_id", "month", "used", "admitted").collect()))


def test_quota_stream_goes_on_over_triggers(spark, tmp_path):
    from maskwright.operators import metering
    from maskwright.streaming import jobs as J

    calls = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("org_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 7).cast("int").alias("tokens")).checkpoint()
    for k in range(3):
        calls.where(F.floor(F.col("event_id") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(str, J.monthly_quota(stream, F.lit(100)).collect()))
    assert got == sorted(map(str, metering.running_quota(calls.withColumn("cap", F.lit(100))).collect()))


def test_groups_without_a_name_and_far_values(spark):
    from maskwright.functions.ranks import quantile_cell
    from maskwright.operators import evaluate, metrics

    rows = [(i, None if i % 2 else "a", float(i)) for i in range(400)] + [(400, "a", 1e12), (401, None, 1e12)]
    d = spark.createDataFrame(rows, "event_id long, name string, value double").withColumn("ts", F.to_timestamp(F.col("event_id")))
    got = {r["name"]: (r["n"], r["p50"], r["high"]) for r in metrics.histogram_summary(d, ["name"], 1000).collect()}
    assert got == {"a": (201, 200.0, 1e12), None: (201, 201.0, 1e12)}
    times = evaluate.latency_stats(d.select(F.col("name").alias("bucket"), F.col("value").alias("ms"), F.lit(1).alias("tokens")), ["bucket"]).collect()
    assert sorted((r["bucket"] or "", r["n"], r["median"]) for r in times) == [("", 201, 201.0), ("a", 201, 200.0)]
    cells = quantile_cell(d, ["name"], "value").groupBy("name").agg(F.countDistinct("_c").alias("k"), F.count("*").alias("n")).collect()
    assert len(cells) == 2 and all(r["k"] > 20 for r in cells)


def _times(make, check, sizes=(8000, 16000)):
    """Seconds of a job over one text with so many spans, the best of two runs each."""
    import time

    took = []
    for n in sizes:
        d, best = make(n), 1e9
        for _ in range(2):
            start = time.time()
            check(d, n)
            best = min(best, time.time() - start)
        took.append(best)
    return took


def test_span_work_is_linear(spark):
    """Twice the spans of one text cost less than 2.5 times the time, each step on its own."""
    mails = lambda n: spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("mail u"), i.cast("string"), F.lit("@ex.org, "))), "").alias("text")).checkpoint()
    digits = lambda n: spark.range(1).select(F.repeat(F.lit("ab1 "), n).alias("text")).checkpoint()
    some = lambda n: spark.range(1).select(F.repeat(F.lit("ab, "), n).alias("text"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 4).alias("start"), (i * 4 + 3).alias("end"), F.when(i % 4 == 3, "org").otherwise("pe").alias("pii_type"))).alias("l")).checkpoint()
    found = lambda d: d.select("text", S.find_all(F.col("text"), r"\d", r"\d").alias("r"))

    def find(d, n):
        r = found(d).select(F.size("r").alias("n"), F.element_at("r", -1).alias("x")).first()
        assert (r["n"], r["x"]["start"], r["x"]["text"]) == (n, 4 * n - 2, "1")

    def replace(d, n):
        assert found(d).select(S.replace_ranges(F.col("text"), F.col("r"), lambda x: F.lit("##")).alias("t")).first()["t"] == "ab## " * n

    def fuse(d, n):
        r = D.fuse(D.detect(d)).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("x")).first()
        assert (r["n"], r["x"]["text"]) == (n, f"u{n}@ex.org")

    def typed(d, n):
        assert len(d.select(S.merge_adjacent_typed(F.col("l"), F.col("text")).alias("l")).first()["l"]) == n // 2

    def trim(d, n):
        assert d.select(D.trim_spans(F.col("l"), F.col("text")).alias("l")).first()["l"][-1][:2] == (4 * n - 4, 4 * n - 2)

    def entities(d, n):
        e = d.select(F.lit(1).alias("doc_id"), "text", F.transform("l", lambda x: F.struct(F.lit("ab,").alias("t"), F.lit("pe").alias("y"), x["start"].alias("s"), (x["end"] + 2).alias("e"))).alias("entities"))
        assert C.validate_entities(e).where("error = 'no_overlap'").count() == n - 1

    for make, check in ((digits, find), (digits, replace), (mails, fuse), (some, typed), (some, trim), (some, entities)):
        took = _times(make, check)
        assert took[1] < 2.5 * took[0] + 0.5, (check.__name__, took)


def test_overlaps_with_earlier_entities_in_any_order(spark):
    """Entities out of order, empty and reversed ones: as all pairs say."""
    rnd = random.Random(9)
    rows = [(i, "x" * 40, [("t", "pe", rnd.choice([None, *range(30)]), rnd.choice([None, *range(30)])) for _ in range(rnd.randint(0, 25))]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, entities array<struct<t:string,y:string,s:int,e:int>>")
    got = {(r["doc_id"], r["place"]) for r in C.validate_entities(d).where("error = 'no_overlap'").collect()}
    want = set()
    for i, _, entities in rows:
        for k, (_, _, s, e) in enumerate(entities):
            if s is not None and e is not None and any(p[2] is not None and p[3] is not None and s < p[3] and e > p[2] for p in entities[:k]):
                want.add((i, k))
    assert got == want


def test_detection_in_whole_texts_equals_brute_force(spark):
    """The patterns by Python's own engine, over documents alone and with a line of each kind inside."""
    import re

    from compare import DATA

    from maskwright.plans.all import QUERIES
    from maskwright.plans.detection import lines, rows
    from maskwright.plans.registry import Tables

    def plainly(frame):
        found = set()
        for r in frame.collect():
            for p in PATTERNS:
                flags = re.I if "i" in p.regex[:5] else 0
                found |= {(r["doc_id"], p.pii_type, m.start(), m.end(), m[0]) for m in re.finditer(re.sub(r"^\(\?Ui?\)", "", p.regex), r["text"], flags)}
        return found

    spans = lambda df: {(r["doc_id"], r["pii_type"], r["start"], r["end"], r["text"]) for r in df.collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert spans(QUERIES["detect_documents"](spark, DATA)) == plainly(docs) != set()
    line = lines(Tables(spark, DATA)).select("doc_id", F.col("text").alias("line"))
    mixed = docs.join(line, "doc_id").select("doc_id", F.concat("text", F.lit("\né "), "line", F.lit(" "), F.substring("text", 1, 300)).alias("text"))
    got = spans(rows(D.detect(mixed)))
    assert got == plainly(mixed) and {x[1] for x in got} == {p.pii_type for p in PATTERNS}


def test_new_keys_of_a_busy_org(spark):
    from maskwright.operators import metering

    asked = spark.range(3000).select(F.lit(1).cast("long").alias("org_id"), F.col("id").alias("request_no"))
    keys = spark.createDataFrame([(1, "k", True)], "org_id long, key_id string, active boolean").withColumn("key_hash", F.lit("h")).withColumn("plan", F.lit("x"))
    plan = spark.createDataFrame([(1, 20, 5)], "org_id long, max_keys int, rate_limit_per_minute int")
    got = metering.admit_new_keys(asked, keys, plan).where("admitted").collect()
    assert sorted(r["request_no"] for r in got) == list(range(19))


def _slots(values, prior):
    """First-free-slot allocation as a loop: {value: hash or None}."""
    seen, out = {}, {}
    for value, digest in sorted(prior):
        seen[digest] = value
    for value, base in values:
        for n in range(1, 11):
            digest = base if n == 1 else f"{base}_{n}"
            if seen.get(digest, value) == value:
                seen[digest] = out[value] = digest
                break
        else:
            out[value] = None
    return out


def test_carried_tokens_never_stand_for_two_values(spark):
    """Random values and carried tokens, some carried twice, ahead or beyond: as a loop, and one value for a hash."""
    rnd = random.Random(4)
    values, prior = [], []
    for request in [None, *range(40)]:
        names = [f"v{i}" for i in range(rnd.randint(1, 26))]
        rnd.shuffle(names)
        values += [(request, v, rnd.choice(["abcd", "ef01"][: rnd.randint(1, 2)]), k) for k, v in enumerate(names)]
        prior += [(request, v, rnd.choice(["abcd", "abcd_2", "abcd_3", "abcd_7", "abcd_10", "abcd_11", "ef01_2"])) for v in [*rnd.sample(names, len(names) // 3), "gone"]]
    v = spark.createDataFrame(values, "request_id long, value string, base_hash string, place long")
    p = spark.createDataFrame(prior, "request_id long, value string, hash string")
    got = T.resolve_collisions(v, p).collect()
    for request in [None, *range(40)]:
        mine = [(x[1], x[2]) for x in values if x[0] == request]
        carried = [x[1:] for x in prior if x[0] == request]
        found = {r["value"]: r["hash"] for r in got if r["request_id"] == request}
        assert found == _slots(mine, carried), request
        taken = [h for h in found.values() if h]
        assert len(set(taken)) == len(taken)
    assert any(r["failed"] for r in got) and any(not r["failed"] for r in got)


def test_tokenize_fails_closed(spark):
    """No key, a refused org, more values than slots, a type that no token has: no text, a reason, no entries."""
    keys = T.key_pads(spark.createDataFrame([(1, bytearray(b"1" * 32)), (2, bytearray(b"2" * 32))], "org_id long, dek binary"))
    span = "array<struct<start:int,end:int,text:string,pii_type:string>>"
    rows = [(1, 1, 1, "anna", [(0, 4, "anna", "pe")]), (2, 9, 1, "anna", [(0, 4, "anna", "pe")]), (3, None, 1, "anna", [(0, 4, "anna", "pe")]), (4, 2, 1, "anna", []), (5, 1, 2, "x y", [(0, 1, "x", "zz")]), (6, 1, 2, "plain", [])]
    docs = spark.createDataFrame(rows, f"doc_id long, org_id long, request_id long, text string, spans {span}")
    quota = spark.createDataFrame([(2, "token_quota_exceeded"), (1, None)], "org_id long, reject_reason string")
    out, entries = T.tokenize(docs, keys, "spans", quota=quota)
    got = {r["doc_id"]: (r["tokenized"], r["reject_reason"]) for r in out.collect()}
    assert got[1][0].startswith("[#pe:") and got[1][1] is None
    assert {i: got[i] for i in range(2, 7)} == {2: (None, "no_key"), 3: (None, "no_key"), 4: (None, "token_quota_exceeded"), 5: (None, "no_token"), 6: (None, "no_token")}
    assert [r["value"] for r in entries.collect()] == ["anna"]
    base = entries.first()["hash"]
    full = spark.createDataFrame([(1, 1, f"w{i}", base if i == 1 else f"{base}_{i}") for i in range(1, 11)], "org_id long, request_id long, value string, hash string")
    out, entries = T.tokenize(docs.where("doc_id = 1"), keys, "spans", prior=full)
    assert [tuple(r) for r in out.collect()] == [(1, None, 1, "no_token")] and entries.count() == 0


def test_rotation_is_one_commit(spark, tmp_path):
    """A failure between vault and keys leaves the version before; a missing key is an error; the count is right."""
    folder, now = str(tmp_path), F.lit("2024-01-01 00:00:00").cast("timestamp")
    deks = lambda c, *orgs: spark.createDataFrame([(o, bytearray(c * 32)) for o in orgs], "org_id long, dek binary")
    entries = spark.createDataFrame([(o, o, f"h{o}{i}", f"v{i}") for o in (1, 2) for i in range(3)], "org_id long, request_id long, hash string, value string")
    first, second, third = deks(b"1", 1, 2), deks(b"2", 1, 2), deks(b"3", 1, 2)
    vault = T.encrypt_values(entries, first, now).checkpoint()
    assert V.commit_rotation(vault, first, second, now, folder, 1) == 6
    broken = third.withColumn("dek", F.when(F.col("org_id") == 1, F.col("dek")).otherwise(F.raise_error(F.lit("stopped")).cast("binary")))
    held = V.current_rotation(spark, folder)[0]

    def plain():
        rows, keys = V.current_rotation(spark, folder)
        return sorted(r["v"] for r in rows.join(keys, "org_id").select(T.decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).alias("v")).collect())

    want = sorted(r["value"] for r in entries.collect())
    assert plain() == want
    held.write.mode("overwrite").parquet(f"{folder}/vault/version=2")  # as if only the vault had been written
    with pytest.raises(Exception, match="stopped"):
        V.commit_rotation(held, second, broken, now, folder, 2)
    assert plain() == want
    assert V.commit_rotation(held, second, third, now, folder, 2) == 6 and plain() == want
    with pytest.raises(ValueError, match="new"):
        V.commit_rotation(held, second, deks(b"4", 1), now, folder, 3)


def test_report_equals_its_parts(spark):
    """Overlapping, repeated and empty spans, unread answers and documents without any: each section is what its own operator says."""
    from maskwright.operators import evaluate as E

    rng = random.Random(5)
    some = lambda: [(rng.choice(["pe", "org"]), a := rng.randrange(30), a + rng.randrange(0, 9)) for _ in range(rng.randrange(7))]
    rows = [(i, rng.choice(["hard_negatives", "wiki", None]), some(), None if i % 7 == 0 else some()) for i in range(120)] + [(200, None, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id long, source string, gold {E.SPANS}, pred {E.SPANS}").repartition(3)
    flat = lambda c: docs.select("doc_id", F.explode(c).alias("x")).select("doc_id", "x.*")
    gold, pred = flat("gold"), flat("pred")
    got = {(r["section"], r["type"], r["other"]): r for r in E.report(docs).collect()}
    score = lambda r: (r["precision"], r["recall"], r["f1"], r["support"])
    for section, counts in (("exact", E.match_exact(gold, pred)), ("partial", E.match_partial(gold, pred))):
        want = E.prf(counts).first()
        assert (got[section, None, None]["n"], *score(got[section, None, None])) == (want["tp"], *score(want))
    assert {k[1]: score(r) for k, r in got.items() if k[0] == "exact" and k[1]} == {r["type"]: score(r) for r in E.prf(E.match_exact(gold, pred, ["type"])).collect()}
    assert {k[1:]: r["n"] for k, r in got.items() if k[0] == "confusion"} == {(r["gold_type"], r["pred_type"]): r["n"] for r in E.confusion_matrix(gold, pred).collect()}
    n = docs.select("source", F.coalesce(F.size("gold"), F.lit(0)).alias("n_gold"), F.coalesce(F.size("pred"), F.lit(0)).alias("n_pred"))
    want = E.hard_negative_rate(n.withColumn("n_gold", F.greatest("n_gold", F.lit(0))).withColumn("n_pred", F.greatest("n_pred", F.lit(0)))).first()
    assert (got["hard_negatives", None, None]["value"], got["hard_negatives", None, None]["support"]) == (want["rate"], want["n"])
    assert got["json_validity", None, None]["value"] == round(sum(r[3] is not None for r in rows) / len(rows), 6)
    assert [got[s, None, None]["n"] for s in ("predictions", "gold", "examples")] == [pred.count(), gold.count(), len(rows)]
    none = E.report(docs.limit(0)).where("section in ('exact', 'json_validity')").select("f1", "value").collect()
    assert {(r["f1"], r["value"]) for r in none} == {(0.0, None), (None, 0.0)}
    fine = [(1, "wiki", [("pe", 0, 4)], [("pe", 0, 4)])]
    assert [r["advice"] for r in E.recommendations(E.report(spark.createDataFrame(fine, docs.schema))).collect()] == ["all_met"]


def test_import_counts_each_kind_of_line(spark, tmp_path):
    """Blank, cut, scalar and whole lines of two files in a tree; a table without rows; the same answer as the tolerant reader."""
    from maskwright.sources import corpora as R

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text('{"n": 1}\n\n  \t\n{"n": 2}\n{"n": \n', encoding="utf-8")
    (tmp_path / "in" / "deep" / "b.jsonl").write_text('{"n": 3, "more": 1}\nnull\nplain\n', encoding="utf-8")
    (tmp_path / "in" / "c.txt").write_text("not read\n", encoding="utf-8")
    table, seen = R.import_jsonl(spark, [str(tmp_path / "in")], str(tmp_path / "out"), "n long")
    assert {r["_source"]: (r["rows"], r["malformed"], r["blank"]) for r in R.line_counts(table).collect()} == {"a": (2, 1, 2), "b": (1, 2, 0)}
    assert seen == {"rows": 3, "malformed": 3, "blank": 2}
    assert sorted(r["n"] for r in table.where("_kind = 'row'").collect()) == [1, 2, 3]
    assert sorted(r["_line"] for r in table.where("_kind = 'malformed'").collect()) == ["null", "plain", '{"n": ']
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.jsonl").write_text("", encoding="utf-8")
    empty, none = R.import_jsonl(spark, [str(tmp_path / "none")], str(tmp_path / "out2"), "n long")
    assert empty.count() == 0 and none == {"rows": 0, "malformed": 0, "blank": 0}


def test_report_documents_are_made_without_joins(spark):
    from maskwright.plans import evaluation as P
    from maskwright.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    made = P._answered(t, P._PRED, P._SEEN)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: sorted(r["gold"]) for r in made.collect() if r["gold"]} == {
        r["doc_id"]: sorted(r["spans"]) for r in P.gold(t).groupBy("doc_id").agg(F.collect_list(F.struct("type", "start", "end")).alias("spans")).collect()
    }


def test_entity_scores_of_odd_and_long_rows(spark):
    import time

    rng, names = random.Random(5), C.NER_LABELS
    some = lambda n: [rng.choice([None, -100, -1, 99, *range(6)]) for _ in range(n)]
    rows = [(some(rng.randrange(9)), some(rng.randrange(9))) for _ in range(700)] + [(None, [1]), ([1], None), ([], []), ([-1], [None]), ([1, 2], [1]), ([1], [1, 2])]

    def entities(ids):
        out, before = [], "O"
        for i, n in enumerate(ids):
            now = names[n] if n is not None and 0 <= n < len(names) else "O"
            if now[:2] == "B-" or (now[:2] == "I-" and before[2:] != now[2:]):
                out.append([i, i, now[2:]])
            elif now != "O":
                out[-1][1] = i
            before = now
        return {tuple(x) for x in out}

    want = [0] * 5
    for g, p in rows:
        kept = [(a, p[i] if i < len(p) else None) for i, a in enumerate(g) if a is not None and a != -100] if g is not None and p is not None else []
        a, b = entities([x for x, _ in kept]), entities([y for _, y in kept])
        want = [x + y for x, y in zip(want, (len(kept), sum(x == y for x, y in kept), len(a & b), len(b - a), len(a - b)), strict=True)]
    got = E.sequence_scores(spark.createDataFrame(rows, "gold array<int>, pred array<int>"), names).first()
    assert [got[c] for c in ("n", "n_right", "tp", "fp", "fn")] == want
    long = spark.range(1).select(F.sequence(F.lit(1), F.lit(40_000)).alias("i")).select(F.transform("i", lambda i: i % 3).alias("gold"), F.transform("i", lambda i: i % 2).alias("pred"))
    E.sequence_scores(long.limit(0), names).collect()
    start = time.time()
    assert E.sequence_scores(long, names).first()["n"] == 40_000
    assert time.time() - start < 8  # comparing all pairs of entities takes longer
