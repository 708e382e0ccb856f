"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python step works on at most about this many bytes of text at once, so its
#: scratch arrays stay small whatever the Arrow batch holds.
SLICE_BYTES = 2_000_000
BATCH_ROWS = 1_024
#: Short rows (keys, pairs of keys) that one part holds before there are more parts.
PART_ROWS = 50_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``. One is made only in local
    mode with none set, as in tests; elsewhere that would be a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_folder(spark)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a frame to a new table in the shared folder and read it: later steps read the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting that at most ``max_rows`` rows exist."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def packed(df: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """A checkpoint of the frame, read in one part more than it holds times ``rows`` rows, or in as many parts as
    before: each part of a shuffle's input writes files of its own, so steps over few rows take few parts."""
    kept = df.checkpoint()
    return kept.coalesce(kept.count() // rows + 1)


def encode_slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Yield (offset, UTF-8 texts) groups of about SLICE_BYTES; a null counts as empty."""
    start, size, group = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > SLICE_BYTES:
            yield start, group
            start, size, group = i, 0, []
        group.append(raw)
        size += len(raw)
    if group:
        yield start, group


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to the workers where their PYTHONPATH doesn't have it."""
    root = Path(__file__).resolve().parents[2]
    known = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in known or getattr(spark.sparkContext, "_maskwright_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "maskwright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "maskwright").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._maskwright_shipped = True


def map_partitions(df: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Run ``run`` on the Arrow batches of each partition of ``df``; a narrow step, no shuffle.

    Where the session has Spark's default of 10,000 rows a batch, it is set to BATCH_ROWS: batches of
    whole documents are held several times outside the heap, by Spark and by Python.
    """
    ensure_importable(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == "10000":
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """Run ``fn`` on each Arrow batch of ``df``, some BATCH_ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):  # Python objects of a few rows at a time
                yield from fn(batch.slice(at, BATCH_ROWS))

    return map_partitions(df, schema, run)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bucket_sample(rows: DataFrame, label: str, key: Column, per_label: int) -> DataFrame:
    """(label, key): at most ``per_label`` keys of every label value, spread by hash.

    A key is a hash that repeated rows share. The keys of a label are dealt into ``per_label``
    buckets and each bucket gives its smallest, so the work is a partial aggregate however
    large a label is, and the result has at most ``labels * per_label`` rows.
    """
    spread = F.xxhash64(key, F.lit(7))
    return (
        rows.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"), F.pmod(spread, F.lit(per_label)).alias("bucket"))
        .agg(F.min(F.struct(F.xxhash64(key, F.lit(11)).alias("order"), key.alias("key"))).alias("m"))
        .select("label", "m.key")
    )
