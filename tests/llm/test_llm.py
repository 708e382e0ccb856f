"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import bz2
import gzip
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
import xxhash
from compare import DATA, connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import chat, decontam, langid, licenses, nearcopies, pieces, quality, secrets, simhash, toxicity, urls
from maskwright.llm.common import held_out, read_table
from maskwright.llm.queries import ORACLES, QUERIES

WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


ODD = [None, "", " ", "\n\n", "😀 ▁ é", "a" * 5000, "x y z " * 800, "\x00\x01", "%41%zz \\u00e9 &#x41;", "null"]


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    rows = [(i if i else None, t, None if i % 2 else "en", None, None, 1.0, "x") for i, t in enumerate(ODD)]
    rows += rows[2:5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string")


# ---- all of them


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(connect(), ORACLES[name])


def applied(spark, d):
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (2, ""), (None, "a b")], "item_id long, text string")
    yield secrets.digest(secrets.scan_secrets(d)), True
    yield toxicity.score_toxicity(d, toxicity.train(d, labels)), True
    yield simhash.near_duplicates(d), True
    yield pieces.encode_pieces(d), True
    yield decontam.find_items(d, items), False
    yield langid.predict(d, langid.train(d)), True
    yield quality.ledger(d), True
    yield licenses.scan_licenses(d), True
    yield toxicity.drop_toxic(d, toxicity.Field()), True
    yield secrets.redact_documents(d), True
    yield decontam.drop_contaminated(d, items), True
    yield simhash.keep_one(d), False
    yield nearcopies.keep_one(d), False


def test_odd_rows(spark):
    d = odd_docs(spark)
    n = d.count()
    for i, (out, whole) in enumerate(applied(spark, d)):
        got = out.collect()
        assert not whole or len(got) == n, i


def test_empty_tables(spark):
    d = odd_docs(spark).limit(0)
    for i, (out, _) in enumerate(applied(spark, d)):
        assert out.collect() == [], i
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, urls.campaign_urls(pages)).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.format_conversations(turns))).collect() == []
    assert quality.ablations(quality.ledger(d)).count() == len(quality.RULES)


# ---- 1 secrets


def naive_base(text):
    """Straight from the rule: leftmost matches of each kind, those that fall short dropped."""
    out = []
    pattern = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def base_of(text):
    raw = text.encode()
    return sorted((s, secrets.KINDS.index(k), e) for s, e, k in secrets._code_points(raw, secrets.scan_text(raw)[0]))


def test_base_spans_equal_the_rule(docs):
    rng = random.Random(1)
    bits = ["password", "Token", "SECRET", "api_key", "apikey=", "ſecret=", "=", ":", " ", '"', "'", "abcdefgh", "x", "AKIA", "ABCDEFGHIJKL12", "0123456789abcdef", "é", "\n", "tokentoken=abcdefgh"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for text in [*made, *docs["text"]]:
        assert base_of(text) == naive_base(text), text[:200]


def spans(text):
    return {(text.encode()[s:e], k) for s, e, k in secrets.scan_text(text.encode())[1]}


def test_nested_layers_are_found_and_mapped():
    plain = "token = abcdefgh12345678"
    b64 = lambda b: base64.b64encode(b).decode()
    twice = b64(b64(plain.encode()).encode())
    zipped = b64(gzip.compress(plain.encode()))
    packed = b64(zlib.compress(plain.encode()))
    url = "".join(f"%{c:02X}" for c in plain.encode())
    code = "".join(f"\\u{ord(c):04x}" for c in plain)
    for hidden in (b64(plain.encode()), twice, zipped, packed, url, code, b64(url.encode()), url.replace("%", "%25")):
        text = f"è prima {hidden} dopo"
        found = spans(text)
        assert any(k == "assign" for _, k in found), hidden
        assert all(part in hidden.encode() for part, _ in found), hidden
    assert spans(url) == {(url.encode(), "assign")}
    assert spans(f"id-{b64(plain.encode())}")
    assert not spans("b2xkIHdvcmRzIG9ubHkgaGVyZQ== nothing here")


def test_every_form_of_escape_is_opened():
    """Long, braced and octal escapes, alone, mixed and inside base64; spans are those of the escaped text."""
    plain = "token = abcdefgh12345678"
    forms = ("\\U{:08x}", "\\u{{{:x}}}", "\\x{{{:X}}}", "\\{:03o}", "\\x{:02x}", "&#x{:x};", "&#{};")
    for f in forms:
        hidden = "".join(f.format(ord(c)) for c in plain)
        assert spans(hidden) == {(hidden.encode(), "assign")}, f
        assert spans("è " + base64.b64encode(hidden.encode()).decode() + " fine")
    mixed = "".join(forms[i % len(forms)].format(ord(c)) for i, c in enumerate(plain))
    assert spans(f"è {mixed} è") == {(mixed.encode(), "assign")}
    assert not spans("C:\\101\\377 \\U00110000 \\u{110000} \\9")


def test_joined_wrapped_and_spaced_layers_are_found():
    secret = "password: hunter2222"
    b64 = lambda raw: base64.b64encode(raw).decode()

    def check(before, inside, after, start=None):
        text = before + inside + after
        found = [(s, e) for s, e, k in secrets.scan_text(text.encode())[1] if k == "assign"]
        at = len(before)
        assert any(at <= s < e <= at + len(inside) for s, e in found), (text, found)

    for after in ("", " end", "/edit/page", "\nEnd of it"):
        for before in ("https://example.com/cb/", "https://example.com/a/bc+def/", "x/yz/"):
            check(before, b64(secret.encode()), after)
            check(before, b64(zlib.compress(secret.encode())).rstrip("="), after)
    rng = random.Random(3)
    filler = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    for raw in (f"{filler} {secret} {filler}".encode(), gzip.compress(f"{filler} {secret}".encode()), zlib.compress(f"{filler} {secret}".encode())):
        for columns in (61, 64, 76):
            for brk in ("\n", "\r\n", " \n  "):
                lines = [b64(raw)[i : i + columns] for i in range(0, len(b64(raw)), columns)]
                check("see this\n", brk.join(lines), "\nthe rest")
    check("", "password: " + "".join(f"%{b:02x}" for b in b"hunter2222"), " x")
    check("", b64(gzip.compress(b"first ") + gzip.compress(secret.encode())), "")
    assert secrets.scan_text(b64(gzip.compress(b"a" * 600) + gzip.compress(b"b" * 600)).encode(), limit=1000)[3] != []


def test_utf16_and_binary_layers_are_found():
    secret, rng = "password: hunter2222", random.Random(6)
    b64 = lambda raw: base64.b64encode(raw).decode()
    noise = rng.randbytes(400)
    for raw in (secret.encode("utf-16"), secret.encode("utf-16-be"), f"è {secret}".encode("utf-16-le"), gzip.compress(secret.encode("utf-16-le")), noise + f" {secret} ".encode() + noise, bz2.compress(b"x") + bz2.compress(secret.encode())):
        for before in ("", "see ", "https://example.com/cb/", "x+y/zz/"):
            text = f"{before}{b64(raw)} end"
            found = [(s, e) for s, e, k in secrets.scan_text(text.encode())[1] if k == "assign"]
            assert any(len(before) <= s < e <= len(text) - 4 for s, e in found), (before, raw[:20])
    at = f"{b64(('x' * 30 + ' ' + secret + ' ' + 'y' * 30).encode('utf-16-le'))}"
    [(s, e)] = {x[:2] for x in secrets.scan_text(at.encode())[1]}
    assert b64(secret.encode("utf-16-le")[:30])[4:20] in at[s - 4 : e + 4] or 75 < s < e < 150


def test_many_large_layers_of_a_text_take_the_memory_of_one():
    # levels of zeros with a secret at the end of each: 20 streams of 16 MB in about 415 KB
    streams = [base64.b64encode(zlib.compress(b"\0" * 16_000_000 + b" token=abcdefgh%02d" % i)) for i in range(20)]
    text = b" ".join(streams)
    tracemalloc.start()
    _, found, opened, refused = secrets.scan_text(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and opened >= 16 and len(found) + len(refused) == 20 and len(found) >= 16


def test_long_joined_runs_take_linear_time():
    raw = base64.b64encode(random.Random(4).randbytes(600_000))
    start = time.process_time()
    secrets.scan_text(b"a/" + raw)
    secrets.scan_text(b"\n".join(raw[i : i + 76] for i in range(0, len(raw), 76)))
    secrets.scan_text(base64.b64encode(b"".join(gzip.compress(b"x") for _ in range(20_000))))
    assert time.process_time() - start < 20


def test_layers_that_repeat_end():
    text = "%2541 " * 50 + base64.b64encode(b"%41%41%41%41%41%41%41%41").decode()
    assert secrets.scan_text(text.encode())[2] < 500


def test_bombs_are_refused_and_counted():
    bomb = base64.b64encode(zlib.compress(b"a" * 1_000_000)).decode()
    assert secrets.scan_text(bomb.encode(), limit=1000)[3] == [(0, len(bomb))]


def test_redaction_masks_what_was_refused(spark):
    bomb = base64.b64encode(zlib.compress(b"z " * 500_000)).decode()
    d = spark.createDataFrame([(1, f"so {bomb} it is"), (2, f"so {bomb[:40]} it is")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(d, max_layer_bytes=1000).collect()}
    assert got[1] == "so [SECRET] it is" and secrets.redact_secrets(d).where("doc_id = 1").first()["text"].startswith("so eJ")


def test_redaction(spark):
    key = "AKIA" + "A" * 16
    d = spark.createDataFrame([(1, f"é {key} x", 25, "keep"), (2, None, None, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, extra string")
    got = {r["doc_id"]: r for r in secrets.redact_documents(d).collect()}
    assert got[1]["text"] == "é [SECRET] x" and got[1]["n_chars"] == 12 and got[1]["extra"] == "keep"
    assert got[2]["text"] is None and got[3]["text"] == "clean"


# ---- 2 toxicity


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    model = toxicity.Field({}, -2.0, tuple(rng.normal(size=4)))
    for n in (1, 2, 5, 7):
        u = np.where(rng.random(n) < 0.5, rng.normal(0, 2, n), model.bias)
        mass, total = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(u[i] for i in range(n) if y[i]) + sum(model.trans[2 * a + b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            mass += w * np.array(y)
        p, _ = toxicity.forward_backward(u[None, :], np.array([n]), model.trans)
        assert np.allclose(p[0], mass / total)
        at, got, top = toxicity.Scorer(model).marginals(u.tolist())
        assert np.allclose(got, (mass / total)[at]) and np.isclose(top, (mass / total).max())


def test_score_is_the_largest_marginal():
    """Of all words, with sticky and alternating chains, weights of both signs and long stretches of plain words."""
    rng = np.random.default_rng(1)
    for trial in range(150):
        trans = tuple(rng.normal(0, 3, 4)) if trial % 3 else [(4.0, -4.0, -4.0, 4.0), (-3.0, 3.0, 3.0, -3.0)][trial // 3 % 2]
        model = toxicity.Field({"bad": 5.0, "good": -6.0}, float(rng.normal(-1, 2)), trans)
        n = int(rng.choice([1, 2, 3, 17, 300, 9001]))
        words = np.where(rng.random(n) < rng.choice([0.0, 0.01, 0.3]), rng.choice(["bad", "good"], n), "x").tolist()
        scorer = toxicity.Scorer(model)
        u = np.array([[scorer.emissions[w] for w in words]])
        p, _ = toxicity.forward_backward(u, np.array([n]), trans)
        assert np.isclose(scorer.score(" ".join(words))[0], p.max(), atol=1e-9), (trial, n)


def test_fits_gather_bounded_rows(spark, monkeypatch):
    """However many rows one labelled id has, and however often a row is repeated."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda *texts: seen.append(list(map(len, texts))))
    monkeypatch.setattr(langid, "fit", lambda texts, _: seen.append([len(t) for t in texts.values()]))
    monkeypatch.setattr(toxicity, "PER_TOXIC", 20)
    monkeypatch.setattr(langid, "PER_LANG", 20)
    ids = [i for i in range(1, 30) if not zlib.crc32(str(i).encode()) % 5 == 0]
    d = spark.range(3000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 500).cast("string")).alias("text"), F.lit("en").alias("lang"))
    toxicity.train(d, spark.createDataFrame([(ids[0], 1)], "doc_id long, toxic int"))
    langid.train(d)
    assert 10 <= seen[0][0] <= 20 and 10 <= seen[1][0] <= 20


def test_toxicity_held_out(spark):
    sf = DATA.replace("0.001", "0.1")
    d, y = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    out = toxicity.score_toxicity(d, toxicity.train(d, y)).join(y.select("doc_id", "toxic"), "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    bad = out["toxic"] == 1
    rank = out["score"].rank()
    n1, n0 = bad.sum(), (~bad).sum()
    assert (rank[bad].sum() - n1 * (n1 + 1) / 2) / n1 / n0 > 0.93
    flagged = out["score"] >= 0.5
    assert flagged[~bad].mean() < 0.02 and flagged[bad].mean() > 0.85
    assert all(out.loc[flagged, "spans"].map(len) > 0)


# ---- 3 SimHash


def naive_fingerprint(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def naive_components(ids, prints, radius=2):
    low = {p: min(i for i, q in zip(ids, prints, strict=True) if q == p) for p in set(prints)}
    ps = sorted(low)
    root = {p: p for p in ps}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(ps, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    best = defaultdict(lambda: 1 << 62)
    for p in ps:
        best[find(p)] = min(best[find(p)], low[p])
    return [best[find(p)] for p in prints]


def test_simhash_equals_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, DATA).collect()}
    ids = docs["doc_id"].tolist()
    prints = [naive_fingerprint(t) for t in docs["text"]]
    for i, p, c in zip(ids, prints, naive_components(ids, prints), strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{p:016x}", c)


def test_hashes_are_those_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_links_find_all_components(spark, shard_rows):
    rng = random.Random(shard_rows)
    near = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            near.append(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    half = rng.getrandbits(32) << 32  # a shard that many share
    near += [half | rng.getrandbits(32) for _ in range(300)]
    values = sorted(set(near))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.hamming_links(frame, 2, shard_rows)).collect()}
    want = naive_components(list(range(len(values))), values)
    got = [roots.get(v, v) for v in signed]
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_long_chains_settle(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def naive_copies(texts):
    own = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(max(1, len(w) - 4))}
    sets, root = [own(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("frequent", [3, 10**9])
def test_near_copies_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(nearcopies, "FREQUENT", frequent)
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "MAX_BROADCAST_SHINGLES", frequent)  # both ways
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", "  ", "one two", "One  two", "one two three four five six"]
    for _ in range(12):
        text = [word() for _ in range(rng.randrange(30, 150))]
        for edits in (0, 1, 2, 3, 4, 6):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    roots = naive_copies(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in nearcopies.keep_one(d).collect()}
    assert kept == {i for i, r in enumerate(roots) if i == r}
    assert len(kept) < len({r["doc_id"] for r in simhash.keep_one(d).collect()})


def test_near_copies_of_a_large_family_are_compared_by_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BOTTOM", 1)  # so that the first round leaves some apart
    compared, possible = [], nearcopies._possible
    monkeypatch.setattr(nearcopies, "_possible", lambda pairs, *rest: compared.append(pairs.count()) or possible(pairs, *rest))
    rng = random.Random(6)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(600):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{i}"
        texts.append(" ".join(copy))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in nearcopies.keep_one(d).collect()] == [0]
    assert sum(compared) < 10 * len(texts)


def test_few_links_take_few_parts(spark):
    """However many parts a shuffle has: each part of its input writes files of its own."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
        found = simhash.components(links)
        assert found.rdd.getNumPartitions() <= 2 + 40  # edges as they are, and the roots behind one shuffle
        assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_copies_without_heavy_shingles_take_no_head_rounds(spark, monkeypatch):
    rounds, possible = [], nearcopies._possible
    monkeypatch.setattr(nearcopies, "BOTTOM", 1)
    monkeypatch.setattr(nearcopies, "_possible", lambda pairs, *rest: rounds.append(pairs.count()) or possible(pairs, *rest))
    rng = random.Random(8)
    texts = []
    for i in range(40):
        base = [f"a{rng.randrange(900)}" for _ in range(60)]
        for at in (5, 30, 55):
            copy = list(base)
            copy[at] = f"x{i}-{at}"
            texts.append(" ".join(copy))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(d).collect()) == [i for i, r in enumerate(naive_copies(texts)) if i == r]
    assert len(rounds) == 2


def test_shingles_that_the_same_texts_share_are_looked_at_once(spark, monkeypatch):
    """Pairs that share half of their text, and a third that shares a little: near copies of none."""
    shared, find = [], nearcopies.shared_shingles
    monkeypatch.setattr(nearcopies, "shared_shingles", lambda *a: shared.append(find(*a)) or shared[-1])
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        half, few = words(200), words(30)
        texts += [" ".join(half + few + words(100)), " ".join(half + few + words(100)), " ".join(few + words(60))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(d).collect()) == list(range(36))
    assert 12 <= shared[0].select("h").distinct().count() <= 12 * 4  # any two of three texts, or all
    assert nearcopies._unlike_sets(spark.createDataFrame([(9, 1), (9, 2), (7, 2), (7, 1), (8, 1), (8, 3)], "h long, t long")).count() == 4


@pytest.mark.parametrize("bound", [0, 100])
def test_near_copies_of_texts_that_repeat(spark, monkeypatch, bound):
    """Whether or not the rows that repeat a text are few enough to be broadcast."""
    monkeypatch.setattr(nearcopies, "MAX_BROADCAST_SHINGLES", bound)
    rng = random.Random(10)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(5)]
    texts = [" ".join(b) for b in base for _ in range(3)] + [" ".join([*b[:-1], "x"]) for b in base for _ in range(2)] + ["", None, " "]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (100, texts[0]), (None, "alone")]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted([*(str(100 - 16 - 2 * i) for i in range(5)), "73", "None"])


def test_pipeline_drops_near_copies(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, read_table(spark, DATA, "documents"), DATA).collect()}
    rows = docs.sort_values("doc_id")
    roots = naive_copies([t or "" for t in rows["text"]])
    assert kept == {d for i, (d, r) in enumerate(zip(rows["doc_id"].tolist(), roots, strict=True)) if i == r}


def test_keep_one(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (2, text), (2, text), (9, "other words are in this text here"), (None, text), (None, "alone in the whole wide world"), (None, "alone in the whole wide world")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"][:3]) for r in kept) == [(0, "alo"), (2, "one"), (9, "oth")]


def test_keep_one_with_clashing_columns_and_rows_that_differ_elsewhere(spark):
    text = "one two three four five six seven"
    rows = [(2, text, 1, "a"), (2, text, 2, "b"), (3, text, 3, "c"), (4, "not a copy of the others at all", 4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key int, _keep_fp string").withColumn("c0", F.lit(1)).withColumn("root", F.lit(2))
    for keep in (simhash.keep_one, nearcopies.keep_one):
        runs = [sorted(map(tuple, keep(d.repartition(n)).collect())) for n in (1, 3)]
        assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [2, 4] and keep(d).columns == d.columns


# ---- 4 pieces


def test_plain_pieces_equal_the_library(docs):
    enc, sp = pieces.Encoder(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [*docs["text"], *(t or "" for t in ODD if t is None or "▁" not in t)]
    for text, ids in zip(texts, enc.encode(texts, [0] * len(texts)), strict=True):
        assert ids.tolist() == sp.encode(text)


def test_dropout_is_lossless_seeded_and_varied(docs):
    texts = [*docs["text"][:60], *(t or "" for t in ODD), "▁ ▁▁ a▁b"]
    place = list(range(len(texts)))
    a, b, c = (pieces.Encoder(dropout=0.2, seed=s).encode(texts, place) for s in (1, 1, 2))
    one = pieces.Encoder(dropout=0.2, seed=1)
    assert all(one.decode(i.tolist()) == t for i, t in zip(a, texts, strict=True))
    assert all((x.tolist() == y.tolist()) for x, y in zip(a, b, strict=True))
    assert sum(x.tolist() != y.tolist() for x, y in zip(a, c, strict=True)) > 50
    alone = one.encode([texts[7]], [7])[0]
    assert alone.tolist() == a[7].tolist()  # the batch doesn't matter
    everything = pieces.Encoder(dropout=1.0).encode(["hello there"], [0])[0]
    assert len(everything) == len(" hello there")


def test_block_and_heap_agree(docs):
    enc = pieces.Encoder(dropout=0.3, seed=5)
    for n, w in enumerate(docs["text"][3].split()[:200]):
        if len(w) < pieces.LONG - 1:
            letters = enc.v.letter[[32, *map(ord, w)]]
            key = enc.keys(np.array([9], np.uint64), np.array([n]))
            block = pieces.encode_block(enc.v, letters[None, :].astype(np.int32), key, enc.limit)[0]
            heap = [p for p, _, _ in pieces.agenda(enc.v, letters.tolist(), int(key[0]), enc.limit)]
            assert [int(x) for x in block if x != -2] == heap


def naive_pieces(v, letters, key, limit):
    """Every candidate at every step, best score first, then leftmost; a skipped one never comes back."""
    spans_ = [(x, i, i + 1) for i, x in enumerate(letters)]
    mixed = lambda a, b: int(pieces._mix(np.array([(key ^ ((a << 32 | b) * 0x9E3779B97F4A7C15)) % 2**64], np.uint64))[0])
    surface = {i: p for p, i in v.ids.items()}
    while True:
        best = None
        for k, ((a, s, _), (b, _, e)) in enumerate(zip(spans_, spans_[1:], strict=False)):
            made = v.ids.get(surface[a] + surface[b], -1) if a >= 0 and b >= 0 else -1
            if made >= 0 and not (limit and mixed(s, e) < limit):
                best = min(best or (1 << 60,), (int(v.rank[made]), s, k, made, e))
        if best is None:
            return [x for x, _, _ in spans_]
        _, s, k, made, e = best
        spans_[k : k + 2] = [(made, s, e)]


def test_dropout_equals_brute_force(docs):
    rng = random.Random(8)
    enc = pieces.Encoder(dropout=0.25, seed=3)
    for n in range(120):
        text = docs["text"][n % len(docs)]
        at, size = rng.randrange(max(1, len(text) - 80)), rng.randrange(1, 80)
        chunk = " " + text[at : at + size].replace(" ", "").replace("\n", "").replace("▁", "")
        if chunk == " ":
            continue
        letters, key = enc.v.letter[[ord(c) for c in chunk]], int(enc.keys(np.array([n], np.uint64), np.array([0]))[0])
        want = naive_pieces(enc.v, letters.tolist(), key, enc.limit)
        assert [p for p, _, _ in pieces.agenda(enc.v, letters.tolist(), key, enc.limit)] == want
        ids = enc.encode([chunk[1:]], [n])[0].tolist()
        assert enc.decode(ids) == chunk[1:] and (-1 in want or ids == want)


def test_long_unspaced_texts_take_no_longer():
    enc = pieces.Encoder(dropout=0.1, seed=3)
    text = "".join(random.Random(1).choices("abcdefghij", k=40_000))
    start = time.process_time()
    assert enc.decode(enc.encode([text], [1])[0].tolist()) == text
    assert time.process_time() - start < 5


def test_decode_frame(spark, docs):
    d = spark.createDataFrame(docs[["doc_id", "text"]])
    enc = pieces.encode_pieces(d)
    assert enc.where("not lossless").count() == 0
    back = pieces.decode_pieces(enc).join(d.withColumnRenamed("text", "was"), "doc_id")
    assert back.where("text != was").count() == 0


# ---- 5 chat


def test_chat_machine_and_escapes(spark):
    t = chat.DEFAULT
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "<|end|></s>\\<|text|>"), (1, 2, "assistant", "[INST]\\\\ <|turn|>"),
        (2, 0, "assistant", "a"), (2, 1, "user", None), (3, 0, "user", "x"), (3, 0, None, "y"), (None, None, "user", "z"), (None, 1, "assistant", "z"),
    ]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert [(x["role"], x["text"]) for x in back[1]["turns"]] == [r[2:] for r in rows[:3]] and back[1]["valid"]
    assert back[1]["loss_text"] == rows[2][3]
    body = back[1]["formatted"]
    assert body.count(t.end) == 3 and "</s>" not in body and "[INST]" not in body
    bad = {r["conv_id"]: list(r["bad_turns"]) for r in out.collect()}
    assert out.where("conv_id is null").count() == 2
    bad.pop(None)
    assert bad == {1: [], 2: [0], 3: [0, 1]} and not back[3]["valid"] and not back[None]["valid"]


def test_chat_machine_is_linear_in_invalid_turns(spark):
    """40,000 turns of a role that may never speak: all are bad, and the last state counts."""
    n = 40_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("other").alias("role"), F.lit("x").alias("text"))
    start = time.perf_counter()
    out = chat.format_conversations(rows).select("bad_turns", "valid").first()
    assert out["bad_turns"] == list(range(n)) and not out["valid"] and time.perf_counter() - start < 15
    moved = chat.Template(moves={"start|a": "one", "one|a": "two", "two|b": "end"}, final=("end",))  # states that are no roles
    said = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate("aab")] + [(2, i, r, "x") for i, r in enumerate("ab")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: (r["bad_turns"], r["valid"]) for r in chat.format_conversations(said, moved).collect()} == {1: ([], True), 2: ([1], False)}


def test_chat_with_odd_rows(spark):
    """Repeated rows, nulls everywhere, clashing columns, a long text; round trip and SQL."""
    rows = [(None if i % 4 == 0 else i % 3, None if i % 5 == 0 else i % 2, r, t) for i, (r, t) in enumerate(itertools.product([None, "user", "assistant", "other", ""], ["", None, "a\\" * 3000, "<|turn|></s>"]))] * 2
    d = spark.createDataFrame([(*r, "v", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, valid int")
    back = chat.read_back(chat.format_conversations(d))
    turns = sorted((x["role"], x["text"]) for r in back.collect() for x in r["turns"])
    assert turns == sorted((r or "", t or "") for _, _, r, t in rows)
    db = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    db.register("frame", frame)
    db.execute("create view conversations as select * from frame")
    odd = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    both = d.select("conv_id", "turn", "role", "text").unionByName(odd)
    assert rows_of(chat.digest(chat.read_back(chat.format_conversations(both)))) == rows_of_sql(db, ORACLES["op5_chat"])


# ---- 6 urls


def test_urls(spark):
    made = [None, "", "no scheme", "http://WWW.a.example.net/en/x?utm_source=f", "https://x.example.net/de/", "HTTP://example.com/de/1", "http://notexample.com/de/", "http://a.org/fr/?q", "http://b.org/x/?b=2&a=1&utm_x=1#t", "http://b.org/x?a=1&b=2", "http://net", "a://b://c/d", "http://h\nost/p\nq"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, spark.createDataFrame([("http://b.org/x?a=1&b=2",), (None,)], "url string")).collect()}
    assert [got[i]["rule"] for i in range(11)] == [None, None, None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None]
    assert got[8]["listed"] and got[8]["verdict"] == got[9]["verdict"] == "block" and got[7]["verdict"] == "allow"
    assert (got[11]["host"], got[11]["path"]) == ("b:", "//c/d") and (got[12]["host"], got[12]["path"]) == ("h\nost", "/p\nq") and got[0]["host"] == ""


def test_urls_without_broadcast_and_with_odd_rows(spark, monkeypatch):
    made = [None, "", "no scheme", "http://a.b/c", "http://a.b/c", "http://a.b/d", "http://x.net/", "http://É.b/c?utm_source=1"] * 3 + ["http://a.b/" + "c" * 20000]
    pages = spark.createDataFrame([(None if i % 5 == 0 else i, u, "h", "k", 1) for i, u in enumerate(made)], "page_id long, url string, host string, key string, block int")
    listed = spark.createDataFrame([("http://a.b/c",), ("http://a.b/c/",), ("http://É.b/c",), (None,)], "url string")
    once = sorted(map(str, urls.filter_urls(pages, listed).collect()))
    assert len(once) == len(made) and sum("listed=True" in r for r in once) == 9
    monkeypatch.setattr(urls, "MAX_BROADCAST_KEYS", 0)
    assert sorted(map(str, urls.filter_urls(pages, listed).collect())) == once


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = urls.build_filter(keys, "key", 5000)
    wants = F.lit(True)
    for i, lane in enumerate(urls._lanes(F.col("key"))):
        wants = wants & (F.col(f"lane{i}").bitwiseAND(lane) == lane)
    hit = lambda df: df.withColumn("block", urls._block(F.col("key"), blocks)).join(bloom, "block").where(wants).count()
    assert hit(keys) == 5000
    assert hit(spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))) < 400


# ---- 7 decontamination


def test_decontamination_on_edited_items(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 3, 5, 6, 9, 20, 33, 64, 65, 200])]
    docs_ = []
    for i, text in items:
        for edits in range(4):
            w = text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit"
            docs_.append((len(docs_), " ".join(rng.choices(vocabulary, k=60)) + " " + " ".join(w).upper() + ", " + " ".join(rng.choices(vocabulary, k=3000))))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for (d, b), (i, a) in itertools.product(docs_, items):
        n = min(5, len(words(a)))
        own, both = grams(words(a), n), grams(words(a), n) & grams(words(b), n)
        if len(both) >= 0.8 * len(own) - 1e-9:
            want[d, i] = len(both)
    assert all((i * 4, i) in want for i, _ in items)  # the short ones too
    got = decontam.find_items(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_found"] for r in got} == want and len(want) > 12


def test_a_contaminated_row_goes_alone(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog again"
    rows = [(None, f"so {item} it was"), (None, "clean text without an id"), (1, item), (1, "another clean text of this id"), (2, None), (3, item), (3, item)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, bad string")
    items = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    want = sorted([str(r) for r in rows if item not in (r[1] or "")])
    assert sorted(str((r["doc_id"], r["text"])) for r in decontam.drop_contaminated(d, items).collect()) == want
    monkeypatch.setattr(decontam, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_ITEMS", 0)
    assert sorted(str((r["doc_id"], r["text"])) for r in decontam.drop_contaminated(d, items).collect()) == want


# ---- 8 language


def naive_bits(texts, text, order):
    """PPM straight from its definition, over all 256 bytes."""
    seen = defaultdict(Counter)
    for t in texts:
        s = [None] * order + list(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1

    def chances(context):
        lower = chances(context[1:]) if context else dict.fromkeys(range(256), 1 / 256)
        c = seen.get(context)
        if not c:
            return lower
        n, q = sum(c.values()), len(c)
        rest = sum(p for x, p in lower.items() if x not in c)
        return {x: c[x] / (n + q) if x in c else q / (n + q) * p / rest for x, p in lower.items()}

    s = [None] * order + list(text)
    return sum(-math.log2(chances(tuple(s[i - order : i]))[s[i]]) for i in range(order, len(s)))


def test_code_lengths_equal_ppm(monkeypatch):
    monkeypatch.setattr(langid, "MIN_COUNT", 1)
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randrange(0, 40)))
    texts = {"x": [word("abc") for _ in range(12)], "y": [word("bcd ") for _ in range(12)], "z": ["é"]}
    trees = langid.fit(texts)
    asked = [word("abcd ") for _ in range(6)] + ["", "a", "zz a", "é", "\x00ß"]
    got = langid.code_lengths(trees, [t.encode() for t in asked])
    want = [[naive_bits([t.encode() for t in texts[g] if t], a.encode(), langid.ORDER) for g in trees.langs] for a in asked]
    assert np.allclose(got, want, rtol=1e-4)


def test_pruned_trees_are_distributions(docs):
    d = docs[docs["text"].str.len() < 3000]
    trees = langid.fit({g: x["text"].head(20).tolist() for g, x in d.groupby("lang")})
    unseen = 256 - (trees.code > 1).sum()
    for cost in trees.cost:
        p = 2.0 ** -cost.astype(float)
        assert 50 < len(p) <= langid.MAX_CONTEXTS and np.allclose(p[:, 2:].sum(1) + p[:, 1] * unseen, 1, atol=1e-3)


def test_rare_languages_are_learnt_and_letters_are_letters(spark):
    rng = random.Random(4)
    free = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    rows = [(i, "".join(rng.choices(f"{chr(97 + i % 20)}{chr(945 + i // 20 % 10)} ", k=60)), f"l{i % 200:03d}") for i in range(2000)]
    rows += [(9000 + i, "λμν " * 3000, "long") for i in range(5)]  # all of its rows are long
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.train(d)
    assert len(trees.langs) == len({g for i, _, g in rows if free(i)}) > 190
    odd = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "ª"), (4, None), (5, "λμν λμν")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, trees).collect()}
    assert got[1] == got[2] == got[4] == "und" and got[3] != "und" and got[5] == "long"


def test_many_languages_keep_the_figures_of_few(monkeypatch):
    """A language's tree does not depend on how many others there are; what does not fit fails."""
    rng = random.Random(8)
    texts = {f"l{i:03d}": ["".join(rng.choices("abcdefgh ", k=4000))] for i in range(60)}
    few, many = langid.fit({g: texts[g] for g in ("l000", "l001")}), langid.fit(texts)
    assert len(few.cost[0]) == len(many.cost[0]) > 200 and np.array_equal(few.cost[0], many.cost[0])
    assert len(langid.fit(texts, 50).cost[0]) == 50
    monkeypatch.setattr(langid, "MAX_TABLE_BYTES", 1 << 16)
    with pytest.raises(ValueError, match="max_contexts"):
        langid.fit(texts)


def test_language_held_out(spark):
    sf = DATA.replace("0.001", "0.01")
    d = read_table(spark, sf, "documents")
    out = langid.predict(d, langid.train(d)).join(d.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97
    odd = langid.predict(spark.createDataFrame([(1, None), (2, "123 !?"), (3, "")], "doc_id long, text string"), langid.train(d)).collect()
    assert {r["lang_pred"] for r in odd} == {"und"}


# ---- 9 quality


def naive_measures(text):
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)]


def test_measures(docs):
    rng = random.Random(0)
    made = [" ".join(rng.choices("ab", k=rng.randrange(40))) + rng.choice(["\n", "\x85", " \x1c ", "\u2003#"]) * 3 for _ in range(300)]
    texts = [*made, *docs["text"], *(t or "" for t in ODD)]
    got = quality.measure([t.encode() for t in texts])
    assert [naive_measures(t) for t in texts] == got.tolist()


def test_ledger_policies_and_ablations(spark):
    rows = quality.ledger(read_table(spark, DATA, "documents")).cache()
    bits = [r["fail_bits"] for r in rows.select("fail_bits").collect()]
    for version in quality.POLICIES:
        m = quality.mask(version)
        assert rows.where(quality.passes(version)).count() == sum(b & m == 0 for b in bits)
        for r in quality.ablations(rows, version).collect():
            bit = next(1 << x.bit for x in quality.RULES if x.name == r["rule"])
            assert (r["n_fail"], r["n_only"]) == (sum(b & bit > 0 for b in bits), sum(b & m == bit for b in bits))


# ---- 10 licences


def test_every_license_rule_knows_its_own_text(spark):
    end = lambda t: t + (" " if t[-1] in ".:;" else "\n \n")
    say = lambda ids, form: "".join(end(licenses.SENTENCES[n][form % len(licenses.SENTENCES[n])]) for n in ids)
    rows = [(name, say(ids, form)) for name, ids in licenses.RULES for form in range(max(len(licenses.SENTENCES[n]) for n in ids))]
    rows += [(name, "\n".join(f"# {w}" for w in re.findall(r"(?:\S+\s*){1,7}", t))) for name, t in rows]
    rows += [("MIT", "**Licensed** under the MIT License."), ("MIT", "_Licensed_ / _under_ the MIT License."), ("MIT", "Licensed\n# under the MIT\n# License.")]
    rows += [("MIT", "MIT License\n#\n# Copyright (c) 2001 A B\n#\n# " + say(["mit-grant", "mit-notice"], 0).replace(" to ", "\n# to "))]
    rows += [("", "2.0."), ("", "This program is free software. But: you can redistribute it."), ("GPL-3.0-or-later", say(["gpl-3-free", "gpl-3-free"], 0))]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: name for i, (name, _) in enumerate(rows)}
    # the SQL over the same texts
    db = duckdb.connect()
    frame = pd.DataFrame({"doc_id": range(len(rows)), "text": [t for _, t in rows]})
    db.register("documents", frame)
    assert {r[0]: r[2] for r in db.execute(ORACLES["op10_licenses"]).fetchall()} == {i: name for i, (name, _) in enumerate(rows)}


def test_licenses(spark):
    say = lambda *names: " ".join(licenses.SENTENCES[n][0] for n in names)
    bsd2 = say("bsd-grant", "bsd-source", "bsd-binary")
    bsd3 = bsd2 + " " + say("bsd-endorse")
    rows = [
        ("", ""), (None, ""), (say("mit-grant", "mit-notice"), "MIT"), (bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"),
        (say("bsd-source", "bsd-grant", "bsd-binary"), ""), (bsd2.replace(" of ", "\nof ").upper(), "BSD-2-Clause"),
        (bsd3 + " Other parts. " + bsd2, "BSD-3-Clause,BSD-2-Clause"), (bsd2 + "\n" + say("bsd-endorse").replace(" the ", "\nthe "), "BSD-3-Clause"),
        ("Prose.\n" + say("mit-ref") + "\nMore | here\n" + say("apache-2.0-ref"), "MIT,Apache-2.0"), ("licensed under nothing", ""),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0-or-later"), ("/* SPDX-License-Identifier:MIT */", "MIT"), ("MIT", ""),
        ("SPDX-License-Identifier: Proprietary\n\nsee\n\nMIT\n", ""), ("# SPDX-License-Identifier: Foo\n# isc", ""), ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"), ("Released under the terms of the MIT license.", "MIT"), ("This file is distributed\nunder the terms of the GPLv3. So.", "GPL-3.0-only"),
        ("   GNU GENERAL PUBLIC LICENSE\n      Version 2, June 1991\n", "GPL-2.0-only"), ("It is made available under the terms of the city.", ""),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == [x for _, x in rows]
    tagged = licenses.Rulebook().sequence("// SPDX-License-Identifier: BSL-1.0")
    assert tagged == ["tag-BSL-1.0"]  # the tag alone is no sentence


# ---- pipeline


def test_pipeline_equals_its_parts(spark):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    d, labels = pd.read_parquet(f"{DATA}/documents.parquet"), read_table(spark, DATA, "labels")
    scorer = toxicity.Scorer(toxicity.train(read_table(spark, DATA, "documents"), labels))
    d = d[[scorer.score(t)[0] < 0.5 for t in d["text"]]]
    d = d.sort_values("doc_id")  # near copies: a Jaccard index of 0.8 over five-word shingles
    d = d[np.array(naive_copies(d["text"].tolist())) == np.arange(len(d))]
    own = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(max(1, len(w) - 4))} - {()}
    items = [own(t) for t in pd.read_parquet(f"{DATA}/benchmark.parquet")["text"]]
    d = d[[not any(len(own(t) & x) >= 0.8 * len(x) - 1e-9 for x in items if x) for t in d["text"]]]
    enc = pieces.Encoder(dropout=0.1, seed=7)
    decoded = {r.doc_id: enc.decode(list(r.token_ids)) for r in out.itertuples()}
    assert set(decoded) == set(d["doc_id"]) and len(out) == len(d) and out["lossless"].all()
    for r in d.itertuples():
        text, spans_ = r.text, [(s, e) for s, _, e in naive_base(r.text)]
        if not spans_:
            assert decoded[r.doc_id] == text
        else:
            assert "[SECRET]" in decoded[r.doc_id] and not naive_base(decoded[r.doc_id])
    assert len(d) < len(pd.read_parquet(f"{DATA}/documents.parquet"))


@pytest.mark.parametrize("size", [0, None])
def test_pipeline_over_odd_and_empty_tables(spark, tmp_path, size):
    """Nulls in every column, empty and long texts, repeated rows; then tables without a row."""
    d = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (2, ""), (None, "a b")], "item_id long, text string")
    for name, table in (("documents", d), ("labels", labels), ("benchmark", items)):
        (table if size is None else table.limit(size)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if size == 0:
        assert got == []
    else:
        texts = d.select("doc_id", "text").collect()
        # a null, an empty text and one of blanks have the same words; repeated rows are copies
        assert len(got) == len({" ".join((r["text"] or "").split(" ")).strip("\n ") for r in texts}) and all(r["lossless"] for r in got)


def test_near_copies_of_odd_rows(spark):
    """Texts without words are one group, and so are repeated rows; a null id stays if its text is the only one."""
    d = odd_docs(spark)
    kept = nearcopies.keep_one(d)
    words = lambda t: tuple((t or "").lower().split(" ")) if (t or "").strip() else ()
    assert kept.columns == d.columns and {words(r["text"]) for r in kept.collect()} == {words(t) for t in ODD} and kept.count() == len({words(t) for t in ODD})
