"""Target-distribution importance resampling: array-scored weights, exact ranks by regular sampling.

Features are runs of one to three words, hashed by CRC-32 into BUCKETS buckets. The bucket counts of the
documents and of the target texts give an array of gains; a document's weight is the sum of the gains of
its features, its score the weight plus keyed Gumbel noise, and the highest scores are drawn.

Ranks come from a parallel sort by regular sampling. Scores are written once as a narrow table. Each task
sorts its run and takes regular samples of it (RUN_SAMPLES to twice as many, whatever the run's length);
all samples, weighted, give the splitters. Counts by range and their running sums say how many rows lie
before each range, so only the ranges that hold drawn rows are exchanged and merged. The driver holds the
bucket counts, the samples of at most MAX_RUNS runs, and the range counts, nothing that grows further.

Results by case: a null text has no words, so weight 0 and the score is the noise alone; a null id gives
the noise of an empty id and is the largest in ties; rows that repeat an id get scores and ranks of their
own, equal rows in any order; an empty table gives an empty one, an empty target gains from no words; very
long texts are read whole, in windows that carry the last two words; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import BATCH_ROWS, encode_slices, map_partitions, written

BUCKETS, MAX_RUN = 10_000, 3
SEED = 42
#: A text is read some so many bytes at a time; words over LONG_WORD bytes are hashed one by one.
WINDOW, LONG_WORD = 4_000_000, 64
#: Regular samples of a run, and the most runs. Together they bound what the driver gathers.
RUN_SAMPLES, MAX_RUNS = 64, 1_024
_ID_OF_NULL = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _crc_table() -> np.ndarray:
    """The remainder of each byte under the reflected polynomial of CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _windows(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(words carried, bytes): a text cut between words, each part behind the last two words before it."""
    if len(raw) <= WINDOW:
        yield 0, raw
        return
    at, tail = 0, []
    while at < len(raw):
        cut = _NO_WORD.search(raw, at + WINDOW)
        end = cut.start() if cut else len(raw)
        part = b" ".join([*tail, raw[at:end]])
        yield len(tail), part
        found: list[bytes] = []
        for m in _WORD.finditer(part):
            found = [*found[-1:], m[0]]
        at, tail = end, found


def features(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, bucket, run length - 1) of every feature that ends behind the carried words of its part."""
    raw = b"\n".join(p for _, p in parts) + b"\n"
    text = _LOWER[np.frombuffer(raw, np.uint8)]
    word = np.concatenate([[False], _IS_WORD[text]])  # the last byte is a line break
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    size = end - start
    begins = np.cumsum([0, *(len(p) + 1 for _, p in parts)])[:-1]
    part = np.searchsorted(begins, start, "right") - 1
    place = np.arange(len(start)) - np.searchsorted(part, part)
    carried = np.array([c for c, _ in parts])[part]
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")  # so the words that go on are a prefix
    n_long = int((size > LONG_WORD).sum())
    longest = int(size[order[n_long:]].max(initial=0))
    going = [int((size[order[n_long:]] > k).sum()) for k in range(longest)]
    s = start[order[n_long:]]

    def follow(register: np.ndarray) -> np.ndarray:
        """The registers after each word's bytes."""
        done = np.empty_like(register)
        for i in order[:n_long]:
            done[i] = zlib.crc32(text[start[i] : end[i]], int(~register[i])) ^ 0xFFFFFFFF
        r = register[order[n_long:]]
        for k, n in enumerate(going):
            r[:n] = _CRC[(r[:n] ^ text[s[:n] + k]) & 255] ^ (r[:n] >> 8)
        done[order[n_long:]] = r
        return done

    parts_of, buckets, runs = [], [], []
    register = follow(np.full(len(start), 0xFFFFFFFF, np.uint32))
    for n in range(MAX_RUN):
        if n:
            spaced = _CRC[(register ^ 0x20) & 255] ^ (register >> 8)
            register = follow(np.concatenate([spaced[:1], spaced[:-1]]))
        ok = np.flatnonzero((place >= n) & (place >= carried))
        parts_of.append(part[ok])
        buckets.append((~register[ok]) % BUCKETS)
        runs.append(np.full(len(ok), n))
    return np.concatenate(parts_of), np.concatenate(buckets), np.concatenate(runs)


def _by_text(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, run length - 1) of the features of some texts at a time."""
    for at, group in encode_slices(texts):
        for owners, parts in _grouped(group):
            part, bucket, run = features(parts)
            yield at + np.array(owners)[part], bucket, run


def _grouped(group: list[bytes]) -> Iterator[tuple[list[int], list[tuple[int, bytes]]]]:
    """All short texts of a group together; a long one window by window."""
    short = [i for i, g in enumerate(group) if len(g) <= WINDOW]
    if short:
        yield short, [(0, group[i]) for i in short]
    for i in set(range(len(group))) - set(short):
        for window in _windows(group[i]):
            yield [i], [window]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """The features of all texts by bucket. Each task sends one row for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                for _, bucket, _ in _by_text(batch.column(0).slice(at, BATCH_ROWS).to_pylist()):
                    total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = map_partitions(texts.select(F.col(text_col).alias("text")), "bucket int, n long", run).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: a thousand times the smoothed log ratio, rounded down."""
    of_all, of_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_all / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                n = part.num_rows
                words, every, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for text, bucket, size in _by_text(part.column(1).to_pylist()):
                    words += np.bincount(text[size == 0], minlength=n)
                    every += np.bincount(text, minlength=n)
                    weight += np.bincount(text, gain[bucket], minlength=n).astype(np.int64)  # exact below 2^53
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(every), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = map_partitions(rows, "doc_id long, n_words long, n_features long, weight long", run)
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


# ---- ranks

_KEY = ("_o", "_d", "_row")  # the negative score, the id, the row's own number


def _sample_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every step-th row of a sorted run; the step doubles whenever twice RUN_SAMPLES are kept."""
    step, seen, kept = 1, 0, []
    for batch in batches:
        columns, at = [batch.column(i).to_numpy() for i in range(3)], 0
        while at < batch.num_rows:
            taken = range(at + -(seen + at) % step, batch.num_rows, step)[: 2 * RUN_SAMPLES - len(kept)]
            kept += [tuple(int(c[i]) for c in columns) for i in taken]
            if len(kept) < 2 * RUN_SAMPLES:
                break
            kept, step, at = kept[::2], 2 * step, taken[-1] + 1
        seen += batch.num_rows
    if kept:
        columns = [pa.array(c, pa.int64()) for c in zip(*kept, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([step] * len(kept), pa.int64())], [*_KEY, "step"])


def splitters(samples: list[tuple], ranges: int) -> list[tuple]:
    """Keys at equal weight among (key, weight) samples: the first keys of all ranges but the first."""
    samples = sorted(samples)
    ahead = np.cumsum([w for _, w in samples]) if samples else np.zeros(0)
    at = np.searchsorted(ahead, [ahead[-1] * i / ranges for i in range(1, ranges)]) if samples else []
    return sorted({samples[i][0] for i in at})


def _place(rows: pa.RecordBatch, cuts: list[tuple], scores: np.ndarray) -> np.ndarray:
    """The range of each row by its key; only keys that share their score with a splitter are compared whole."""
    o, d, r = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in _KEY)
    low, high = np.searchsorted(scores, o, "left"), np.searchsorted(scores, o, "right")
    for i in np.flatnonzero(low < high):
        high[i] = bisect.bisect_right(cuts, (int(o[i]), int(d[i]), int(r[i])))
    return high


def draw(scored: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, ranges: int | None = None) -> DataFrame:
    """Add ``rank`` to the rows (doc_id, n_words, n_features, weight, score): the place among the drawn, null elsewhere."""
    spark = scored.sparkSession
    table = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    keyed = table.withColumn("_o", -F.col("score")).withColumn("_d", F.coalesce("doc_id", F.lit(_ID_OF_NULL)))
    able = keyed.where(F.col("n_words") >= min_words)
    n = able.count()
    most = share[0] * n // share[1]
    kept = ["doc_id", "n_features", "weight", "score"]
    if not most:
        return table.select(*kept, F.lit(None).cast("long").alias("rank"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = able.select(*_KEY).coalesce(MAX_RUNS).sortWithinPartitions(*_KEY)
    samples = [((r[0], r[1], r[2]), r[3]) for r in map_partitions(runs, "_o long, _d long, _row long, step long", _sample_run).collect()]
    cuts = splitters(samples, ranges)
    scores = np.array([c[0] for c in cuts], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            total += np.bincount(_place(batch, cuts, scores), minlength=len(cuts) + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["range", "n"])

    sizes = np.zeros(len(cuts) + 1, np.int64)
    for r in map_partitions(able.select(*_KEY), "range long, n long", count).groupBy("range").agg(F.sum("n").alias("n")).collect():
        sizes[r["range"]] = r.n
    before = np.cumsum(sizes) - sizes
    in_play = int(np.searchsorted(before, most))  # ranges from here on begin behind the last drawn row

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch, cuts, scores)
            at[batch.column(batch.schema.get_field_index("n_words")).to_numpy() < min_words] = len(before)
            at = np.minimum(at, in_play)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.append(before, 0)[at])], [*batch.schema.names, "_range", "_before"])

    columns = [*kept, "n_words", *_KEY]
    placed = map_partitions(keyed.select(*columns), ", ".join(f"{c} long" for c in [*columns, "_range", "_before"]), place)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*_KEY)) + F.col("_before")
    ranked = placed.where(F.col("_range") < in_play).withColumn("rank", own.cast("long"))
    ranked = ranked.select(*kept, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return ranked.unionByName(placed.where(F.col("_range") >= in_play).select(*kept, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``docs`` weighed by their likeness to ``target`` (text), the best drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target))
    return draw(weigh(docs, gain, id_col, text_col), share, min_words)
