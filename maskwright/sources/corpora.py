"""Readers and writers of annotated corpora, and the choice of rows by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.functions.frames import bounded_broadcast
from maskwright.functions.ranks import hash_rank, join_by

ENTITY = "struct<text:string,type:string,start:int,end:int,t:string,y:string,s:int,e:int>"
EXAMPLE = f"text string, entities array<{ENTITY}>"


def read_jsonl(spark: SparkSession, paths, schema: str = EXAMPLE) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines). Blank lines are ignored, malformed ones set apart with their text."""
    fields = StructType.fromDDL(f"{schema}, _bad string")
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").where("_bad is null").drop("_bad"), parsed.where("r._bad is not null").select(F.col("r._bad").alias("line"))


def read_jsonl_tree(spark: SparkSession, roots: list[str], schema: str = EXAMPLE) -> DataFrame:
    """Every ``*.jsonl`` under the roots; ``_source`` is the file's stem."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(roots)
    return df.withColumn("_source", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""))


def import_jsonl(spark: SparkSession, roots: list[str], folder: str, schema: str = EXAMPLE, source: Column | None = None, glob: str = "*.jsonl") -> tuple[DataFrame, dict[str, int]]:
    """Every line of the files under the roots as one table, and (rows, malformed, blank) counted as it is written.

    Lines are read and parsed once. The table is laid out by ``_kind`` (row, malformed or blank), so readers of the
    rows don't touch the rest; ``_source`` is the file's stem unless another column of the path is given, and
    ``_line`` is the text of a malformed line.
    """
    fields = StructType.fromDDL(f"{schema}, _bad string")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "") if source is None else source
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(roots)
    parsed = lines.select("value", stem.alias("_source"), F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    kind = F.when(~F.col("value").rlike(r"\S"), "blank").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed").otherwise("row")
    rows = parsed.withColumn("_kind", kind)
    seen = Observation()
    count = lambda name: F.count(F.when(F.col("_kind") == name, 1))
    rows = rows.observe(seen, count("row").alias("rows"), count("malformed").alias("malformed"), count("blank").alias("blank"))
    out = rows.select(*(F.col(f"r.{f.name}").alias(f.name) for f in fields if f.name != "_bad"), "_source", F.when(F.col("_kind") == "malformed", F.col("value")).alias("_line"), "_kind")
    out.write.partitionBy("_kind").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder), seen.get


def line_counts(imported: DataFrame) -> DataFrame:
    """(_source, rows, malformed, blank) of an imported table; reads two columns."""
    count = lambda name: F.count(F.when(F.col("_kind") == name, 1))
    return imported.groupBy("_source").agg(count("row").alias("rows"), count("malformed").alias("malformed"), count("blank").alias("blank"))


def read_raw_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_corpus(df: DataFrame, folder: str, by: str = "_source", fmt: str = "json") -> None:
    """One folder for each source or split; the column stays in the rows under ``<by>_label``."""
    df.withColumn(f"{by}_label", F.col(by)).write.mode("overwrite").partitionBy(by).format(fmt).save(folder)


def write_labels(df: DataFrame, folder: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(folder)


def language_column(df: DataFrame) -> str | None:
    return next((c for c in ("language", "lang", "Language") if c in df.columns), None)


def language_filter(df: DataFrame, languages: list[str]) -> DataFrame:
    """Rows of the languages; all rows where the frame has no language column."""
    name = language_column(df)
    return df if name is None else df.where(F.col(name).isin(*languages))


def language_mix(df: DataFrame, target: str, other: str, ratio: float, id_col: str, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """All rows of ``target`` and int(ratio * their number) rows of ``other``, chosen by hash; with ``by``
    the numbers hold in each group, rows without a group being one."""
    name, by = language_column(df), by or []
    goal = df.where(F.col(name) == target)
    tmp = [*by, "_all"]
    pool = hash_rank(df.where(F.col(name) == other).withColumn("_all", F.lit(1)), tmp, id_col, seed, "_rank")
    want = goal.withColumn("_all", F.lit(1)).groupBy(*tmp).agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_want"))
    taken = join_by(pool, bounded_broadcast(want), tmp).where(F.col("_rank") <= F.col("_want"))
    return goal.unionByName(taken.select(*df.columns))


def consolidate_splits(df: DataFrame, raw: str, target: str, other: str, ratio: float, id_col: str, out: str = "split", seed: int = 42) -> DataFrame:
    """The canonical splits of a corpus that names its splits by language (``train_it``): those of ``target``
    whole, and int(ratio * rows) rows of each split of ``other``, chosen by hash. Splits of other languages
    or of none go; where nothing is left, all rows come back under their own names."""
    marked = df.withColumn("_mark", F.lower(F.regexp_extract(F.col(raw), r"_([A-Za-z]+)$", 1)))
    matched = marked.where((F.col("_mark") == target) | ((F.col("_mark") == other) & F.lit(ratio > 0)))
    if matched.isEmpty():
        return df.withColumn(out, F.col(raw))
    named = matched.withColumn(out, canonical_split(F.col(raw)))
    pool = hash_rank(named.where(F.col("_mark") == other), [out], id_col, seed, "_rank")
    want = named.where(F.col("_mark") == other).groupBy(out).agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_want"))
    taken = join_by(pool, bounded_broadcast(want), [out]).where(F.col("_rank") <= F.col("_want"))
    goal = named.where(F.col("_mark") == target)
    return goal.unionByName(taken.select(*goal.columns)).drop("_mark")


def canonical_split(split: Column) -> Column:
    """``train_it`` and the like to train, val or test."""
    head = F.lower(F.regexp_extract(split, r"^([A-Za-z]+)", 1))
    return F.when(head.isin("val", "valid", "validation", "dev"), "val").otherwise(head)


def read_chat(df: DataFrame) -> DataFrame:
    """Text (user) and gold entities (assistant JSON; none where it is not valid) of chat rows."""
    said = lambda role: F.element_at(F.filter("messages", lambda m: m["role"] == role), 1)["content"]
    rest = [c for c in df.columns if c != "messages"]
    kind = "array<struct<t:string,y:string,s:int,e:int>>"
    return df.select(*rest, said("user").alias("text"), F.coalesce(F.from_json(said("assistant"), kind), F.array().cast(kind)).alias("entities"))


def normalize_keys(entities: Column) -> Column:
    """Elements with text/type/start/end or t/y/s/e become (text, type, start, end)."""
    either = lambda x, a, b: F.coalesce(x[a], x[b])
    return F.transform(
        entities,
        lambda x: F.struct(
            either(x, "text", "t").alias("text"), either(x, "type", "y").alias("type"), either(x, "start", "s").alias("start"), either(x, "end", "e").alias("end")
        ),
    )


def first_layout(columns: list[str]) -> Column:
    """(layout, entities) of the first column, in the order given, that has entities."""
    out = F.when(F.size(columns[0]) > 0, F.struct(F.lit(columns[0]).alias("layout"), F.col(columns[0]).alias("entities")))
    for c in columns[1:]:
        out = out.when(F.size(c) > 0, F.struct(F.lit(c).alias("layout"), F.col(c).alias("entities")))
    return out.otherwise(F.struct(F.lit(columns[-1]).alias("layout"), F.col(columns[-1]).alias("entities")))
