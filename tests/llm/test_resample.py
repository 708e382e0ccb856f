"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import DATA
from test_llm import odd_docs

from maskwright.llm import resample as R
from maskwright.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def naive_buckets(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def naive(docs, target, share=5, min_words=20):
    """Rows (doc_id, n_features, weight, score, rank) sorted, of (doc_id, text) pairs."""
    of_docs = [(i, *naive_buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, bs in of_docs for b in bs), Counter(b for x in target for b in naive_buckets(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, bs in of_docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in bs)
        rows.append([i, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], float("inf") if r[0] is None else r[0]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert got(QUERIES["op13_resample"](spark, DATA)) == naive(docs, target)


@pytest.mark.parametrize("window", [4_000_000, 60])
def test_odd_rows_windows_and_ties(spark, monkeypatch, window):
    """Nulls, empty, long, repeated; windows carry words; hundreds of equal keys spread over the ranges."""
    monkeypatch.setattr(R, "WINDOW", window)
    d = odd_docs(spark).select("doc_id", "text", "n_chars", "score")
    long = spark.createDataFrame([(i % 7 if i % 3 else None, "éa B-c2 " * 30 + "w" * 90 * (i % 2) + f" {'x y ' * (i % 5)}", None, 1.0) for i in range(300)], d.schema)
    d = d.unionByName(long)
    target = spark.createDataFrame([("a b C c2 éa",), (None,), ("",)], "text string")
    want = naive([(r.doc_id, r.text) for r in d.collect()], ["a b C c2 éa"], share=40)
    assert got(R.resample(d, target, (40, 100))) == want


def test_empty_tables(spark):
    d = odd_docs(spark)
    target = spark.createDataFrame([("a b",)], "text string")
    assert R.resample(d.limit(0), target).collect() == []
    assert R.resample(d, target.limit(0)).count() == d.count()


def test_regular_samples_bound_the_ranges(monkeypatch):
    """Runs of unlike lengths: no range holds over two shares of the rows and the runs' steps."""
    import pyarrow as pa

    monkeypatch.setattr(R, "RUN_SAMPLES", 8)
    rnd, samples, rows, steps = random.Random(3), [], [], 0
    for size in (3, 100, 1000, 5000):
        run = sorted((rnd.randrange(1000), rnd.randrange(50), i) for i in range(size))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*run)], list(R._KEY))
        out = list(R._sample_run(batch.slice(a, 37) for a in range(0, size, 37)))[0].to_pylist()
        assert min(8, size) <= len(out) < 16 and [(o["_o"], o["_d"], o["_row"]) for o in out] == run[:: out[0]["step"]]
        samples += [((o["_o"], o["_d"], o["_row"]), o["step"]) for o in out]
        rows, steps = rows + run, steps + out[0]["step"]
    cuts = R.splitters(samples, 10)
    assert len(cuts) == 9
    counts = np.bincount([sum(c <= r for c in cuts) for r in rows])
    assert counts.max() <= 2 * len(rows) / 10 + steps
