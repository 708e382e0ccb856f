"""Streaming forms: tokenisation with a memory, windowed counts, a running quota, audit rows, expiry.

Late rows are dropped behind the watermark (two minutes for rate counts, one day for daily
usage), and so is the state of windows behind it. The quota counts calls in the order of the batches
and by time inside one. The batch operators are the exact form.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskwright.functions import spans as S
from maskwright.functions.frames import shared_folder
from maskwright.functions.patterns import PATTERNS
from maskwright.functions.ranks import join_by
from maskwright.operators import metering
from maskwright.operators.detect import detect, fuse
from maskwright.operators.metrics import org_pseudonym
from maskwright.operators.tokens import HASH_DIGITS, MAX_SUFFIX, format_token, hmac_hash


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, one file or a folder of files, as a stream of files."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):  # one file; a stream's path must be a folder
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and read it.

    With ``key`` the stream runs in update mode, so that state behind the watermark goes, and the last
    row of each key counts; else it appends. A batch that is run again overwrites its own folder.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    spark.conf.set(_PROVIDER, _ROCKS)  # arbitrary state with timers and expiry needs it

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = df.writeStream.outputMode("update" if key else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    if key:
        rest = [c for c in df.columns if c not in key]
        found = found.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*key, "m.*")
    return found.select(*df.columns)


def tokenize(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, n_spans, tokenized) of a stream (doc_id, text): emails become keyed tokens.
    ``keys`` is one row (ipad, opad)."""
    found = docs.select("doc_id", "text", S.find_all(F.col("text"), PATTERNS[2].regex, "@").alias("r")).join(F.broadcast(keys), how="cross")  # one row
    token = lambda m: F.concat(F.lit("[#em:"), hmac_hash(m["text"], F.col("ipad"), F.col("opad")), F.lit("]"))
    packed = found.select("doc_id", "text", F.transform("r", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), token(m).alias("new"))).alias("r"))
    return packed.select("doc_id", F.size("r").cast("long").alias("n_spans"), S.replace_ranges(F.col("text"), F.col("r"), lambda x: x["new"]).alias("tokenized"))


def rate_counts(calls: DataFrame, key: str, late: str = "2 minutes") -> DataFrame:
    """Calls of a key in each clock minute."""
    return calls.withWatermark("ts", late).groupBy(key, F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("minute"), "n")


def usage_daily(calls: DataFrame, ops: tuple[str, ...], late: str = "1 day") -> DataFrame:
    sums = [F.sum((F.col("op") == o).cast("long")).alias(f"n_{o}") for o in ops]
    daily = calls.withWatermark("ts", late).groupBy("org_id", F.window("ts", "1 day").alias("w")).agg(*sums, F.sum("tokens").alias("tokens"))
    return daily.select("org_id", F.to_date("w.start").alias("day"), *(f"n_{o}" for o in ops), "tokens")


def audit(calls: DataFrame) -> DataFrame:
    """One record for each call; the org is a pseudonym."""
    return calls.select("event_id", org_pseudonym(F.col("org_id")).alias("org"), F.col("op").alias("operation"), "tokens", F.round("duration_ms", 3).alias("duration_ms"))


# ---- tokens with a memory

_SPAN = "array<struct<start:int,end:int,text:string,pii_type:string>>"


class _Slots(StatefulProcessor):
    """Gives the values of a request's texts their hashes: the first slot of a base hash that is free or the
    value's own. A request's slots are one value of the state, read and written once a trigger, which ends
    ``ttl`` milliseconds after the last write."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "hashes array<string>, owners array<string>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.taken.get() if self.taken.exists() else None
        taken = dict(zip(known[0], known[1], strict=True)) if known else {}
        before = len(taken)
        place = lambda r: (r.turn is not None, r.turn or 0, r.doc_id is not None, r.doc_id or 0)  # noqa: E731  nulls first, as Spark sorts
        for row in sorted(rows, key=place):  # a request has few texts
            hashes = [_slot(base, value, taken) for base, value in zip(row.bases, row.owners, strict=True)]
            yield Row(doc_id=row.doc_id, text=row.text, starts=row.starts, ends=row.ends, types=row.types, hashes=hashes)
        if len(taken) > before:
            self.taken.update((list(taken), list(taken.values())))

    def close(self) -> None:
        pass


def _slot(base: str, value: str, taken: dict[str, str]) -> str | None:
    """The first slot of a base hash that is free or the value's own; it is the value's from now on."""
    for n in range(1, MAX_SUFFIX + 1):
        digest = base if n == 1 else f"{base}_{n}"
        if taken.setdefault(digest, value) == value:
            return digest
    return None


def tokenize_requests(docs: DataFrame, keys: DataFrame, spans_col: str | None = None, digits: int = HASH_DIGITS, ttl_seconds: int | None = None) -> DataFrame:
    """(doc_id, tokenized, n_spans, reject_reason) of a stream (doc_id, org_id, request_id, turn, text): the texts
    of a request share their tokens, whichever trigger brings them, in the order of the triggers and by turn
    inside one. All patterns are looked for, unless ``spans_col`` names spans that are given. ``keys`` is a
    table (org_id, ipad, opad).

    It fails closed like the batch form: null text and a reason for an org without a key (``no_key``) and for a text
    with a value that has no token (``no_token``); the texts of the request before it have gone out by then.
    A request is forgotten ``ttl_seconds`` of clock time after its last new value; without, never. A stream with
    a clock has no end, so ``drain`` is for those without.
    """
    spans = spans_col or "spans"
    found = docs if spans_col else fuse(detect(docs))
    pads = F.broadcast(keys.select("org_id", "ipad", "opad").limit(100_000))
    four = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["pii_type"].alias("pii_type")))
    known = join_by(found.withColumn(spans, four), pads, ["org_id"], "left")
    part = lambda f: F.transform(F.coalesce(F.when(F.col("ipad").isNotNull(), F.col(spans)), F.array().cast(_SPAN)).cast(_SPAN), f)
    rows = known.select(
        "org_id",
        "request_id",
        "doc_id",
        F.col("turn").cast("long").alias("turn"),
        "text",
        part(lambda x: x["start"]).alias("starts"),
        part(lambda x: x["end"]).alias("ends"),
        part(lambda x: x["pii_type"]).alias("types"),
        part(lambda x: x["text"]).alias("owners"),
        part(lambda x: hmac_hash(x["text"], F.col("ipad"), F.col("opad"), digits)).alias("bases"),
        F.col("ipad").isNull().alias("no_key"),
    )
    ttl = None if ttl_seconds is None else ttl_seconds * 1000
    out = "doc_id long, text string, starts array<int>, ends array<int>, types array<string>, hashes array<string>"
    placed = rows.where("not no_key").groupBy("org_id", "request_id").transformWithState(_Slots(ttl), out, "append", "none" if ttl is None else "processingTime")
    zipped = F.arrays_zip("starts", "ends", "types", "hashes")
    tokens = F.transform(zipped, lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), format_token(x["types"], x["hashes"]).alias("new")))
    made = placed.select("doc_id", "text", tokens.alias("r"))
    failed = F.exists("r", lambda x: x["new"].isNull())
    text = F.when(~failed, S.replace_ranges(F.col("text"), F.col("r"), lambda x: x["new"]))
    done = made.select("doc_id", text.alias("tokenized"), F.size("r").cast("long").alias("n_spans"), F.when(failed, "no_token").alias("reject_reason"))
    return done.unionByName(rows.where("no_key").select("doc_id", F.lit(None).cast("string").alias("tokenized"), F.lit(0).cast("long").alias("n_spans"), F.lit("no_key").alias("reject_reason")))


def monthly_quota(calls: DataFrame, cap: Column) -> DataFrame:
    """(event_id, org_id, month, used, admitted) of a stream of calls, run over what is there now: a running total
    for each org and month that a refused call does not raise.

    Each trigger's calls are folded by the batch form, sorted by (ts, id) in Spark, and start from the totals of
    the triggers before, a small table written with the trigger's number: a task holds one Arrow batch, however
    many calls of one org a trigger brings, and a trigger that is run again gives the same rows.
    """
    spark, folder = calls.sparkSession, shared_folder(calls.sparkSession)
    keyed = calls.select("org_id", "ts", "event_id", "tokens", cap.cast("long").alias("cap"))

    def fold(batch: DataFrame, number: int) -> None:
        used = spark.read.parquet(f"{folder}/used/batch={number - 1}") if number else None
        metering.running_quota(batch, used).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        now = spark.read.parquet(f"{folder}/out/batch={number}").groupBy("org_id", "month").agg(F.max("used").alias("used"))
        if used is not None:
            now = used.unionByName(now).groupBy("org_id", "month").agg(F.max("used").alias("used"))
        now.write.mode("overwrite").parquet(f"{folder}/used/batch={number}")

    run = keyed.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(fold).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "org_id", "month", "used", "admitted")


# ---- expiry


class _Expiry(StatefulProcessor):
    """``stored`` when a key begins to live, ``expired`` when it has not been written for ``ttl`` milliseconds of event time."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.until.get()[0] if self.until.exists() else None
        first = until
        for at in sorted(r.at for r in rows):
            if until is not None and at >= until:
                yield Row(org_id=key[0], request_id=key[1], token_hash=key[2], event="expired", at=until)
                until = None
            if until is None:
                yield Row(org_id=key[0], request_id=key[1], token_hash=key[2], event="stored", at=at)
            until = max(until or 0, at + self.ttl)
        if until != first:
            if first is not None:
                self.handle.deleteTimer(first)
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = self.until.get()[0]
        self.until.clear()
        yield Row(org_id=key[0], request_id=key[1], token_hash=key[2], event="expired", at=until)

    def close(self) -> None:
        pass


def vault_ttl(rows: DataFrame, ttl_seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """(org_id, request_id, token_hash, event, at) of a stream of vault rows with ``created_at``: when a key begins
    to live and when it has not been written for ``ttl_seconds`` of event time. Timers fire behind the watermark,
    so a finite stream ends, and the keys that live on at its end stay without an ``expired``."""
    at = F.unix_millis("created_at").alias("at")
    keyed = rows.withWatermark("created_at", late).select("org_id", "request_id", "token_hash", "created_at", at)
    out = "org_id long, request_id long, token_hash string, event string, at long"
    events = keyed.groupBy("org_id", "request_id", "token_hash").transformWithState(_Expiry(ttl_seconds * 1000), out, "append", "eventTime")
    return events.withColumn("at", F.timestamp_millis("at").cast("timestamp_ntz"))
