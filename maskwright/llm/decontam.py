"""Benchmark decontamination: size-partitioned MinHash containment search.

A text's words are its runs of letters and digits in lower case. An item's shingles are five words,
or all its words if it has fewer (no words, no shingle); a document has shingles of the same width.
An item is found in a document if the document has at least ``threshold`` of the item's distinct
shingles. So an item of fewer than five words is found where these words stand one after the other.

Items are partitioned by their number of shingles (powers of two). An item's sketch
is its smallest shingle hashes (bottom-k MinHash); a partition's k is the number of
shingles that its largest size may miss, plus one. So a document that contains an item
has at least one hash of its sketch, and the search loses nothing; documents with too
few shingles for an item's partition are passed over. Candidates are then verified by
the exact shingles of both texts. Texts are not shuffled while the candidate pairs are
few enough to be broadcast, which is counted first.

Results by case: null and empty texts have no shingles, are found in nothing and
contain nothing; repeated rows of one id count as one document (the best of its texts
is reported) and repeated item rows as one item; a null id is an id of its own; empty
tables give empty results; only the id and text columns are read; very long texts are
searched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import bounded_broadcast, ensure_checkpoint_dir

WIDTH, THRESHOLD = 5, 0.8
#: Sketch rows, candidate pairs and ids that may be broadcast (about 20 bytes a row), and
#: items with their shingles (about 40 bytes a word).
MAX_BROADCAST_ROWS, MAX_BROADCAST_ITEMS = 500_000, 5_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, n, h): a row for each shingle of (id, text) rows, repeats included, with its 64-bit
    hash; n is the number of shingles of the text. A text with fewer words has no rows.

    The words are zipped with themselves shifted, exploded and hashed in generated code:
    a lambda over the words would be interpreted for each shingle. The explode is an outer
    one, as else a filter on the array's size would be put below the step that makes it.
    """
    w = df.select("id", words(F.col("text")).alias("w"))
    w = w.select("id", (F.size("w") - (width - 1)).alias("n"), "w")
    names = [f"w{k}" for k in range(width)]
    shifted = F.arrays_zip(*(F.slice("w", F.lit(k + 1), F.greatest(F.col("n"), F.lit(0))).alias(name) for k, name in enumerate(names)))
    rows = w.select("id", "n", F.inline_outer(shifted)).where(f"{names[-1]} is not null")
    return rows.select("id", "n", F.xxhash64(*names).alias("h"))


def with_shingles(df: DataFrame, name: str, width: int) -> DataFrame:
    """Replace ``text`` by its distinct shingles as strings. The words are a column of their own,
    so that they are cut once and not once for each shingle."""
    rest = [c for c in df.columns if c != "text"]
    w = df.select(*rest, words(F.col("text")).alias("w"))
    n = F.size("w")
    own = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice("w", i, width), " "))
    return w.select(*rest, F.array_distinct(F.when(n >= width, own).otherwise(F.array().cast("array<string>"))).alias(name))


def sketches(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """(h, item, least): the sketch of each item and the shingles a document must have."""
    rows = items.select(F.struct("id", "text").alias("id"), "text").distinct()  # two texts of one id are two sets
    sets = hashed(rows, width).groupBy("id").agg(F.array_sort(F.collect_set("h")).alias("h")).select(F.col("id.id").alias("id"), "h")
    n = F.size("h")
    floor = F.floor(F.log2(n))
    low, high = F.pow(F.lit(2), floor), F.pow(F.lit(2), floor + 1) - 1
    need = lambda size: F.ceil(F.lit(threshold) * size - 1e-9)
    k = F.least(n, (high - need(high) + 1).cast("int"))
    return sets.select(F.col("id").alias("item"), need(low).cast("int").alias("least"), F.explode_outer(F.slice("h", F.lit(1), k)).alias("h")).distinct()


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Distinct (id, item) pairs that share a sketch hash; docs and items have (id, text).

    Sketches beyond the bound meet the documents' shingles in a shuffled inner join, whose hot
    hashes adaptive execution splits.
    """
    probes = bounded_broadcast(sketches(items, threshold, width), MAX_BROADCAST_ROWS)
    return hashed(docs, width).join(probes, "h").where("n >= least").select("id", "item").distinct()


def _contained(d: DataFrame, i: DataFrame, threshold: float) -> DataFrame:
    """(id, item, n_item, n_found) of the documents d (id, text) and the items i (id, text) found in them."""
    ensure_checkpoint_dir(d.sparkSession)
    i = i.select("*", F.least(F.size(words(F.col("text"))), F.lit(WIDTH)).alias("width"))
    found = [_of_width(d, i.where(F.col("width") == r["width"]).select("id", "text"), threshold, r["width"]) for r in i.select("width").distinct().orderBy("width").collect() if r["width"]]
    if not found:
        return d.select("id").limit(0).crossJoin(i.select(F.col("id").alias("item"), F.lit(0).alias("n_item"), F.lit(0).alias("n_found")).limit(0))
    return reduce(DataFrame.unionByName, found)


def _of_width(d: DataFrame, i: DataFrame, threshold: float, width: int) -> DataFrame:
    pairs = candidates(d, i, threshold, width).checkpoint()  # read twice below; the search runs once
    own = with_shingles(i.select(F.col("id").alias("item_key"), "text"), "item_shingles", width).distinct()
    ids = pairs.select(F.col("id").alias("doc_key")).distinct()
    texts = d.join(bounded_broadcast(ids, MAX_BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("doc_key")), "left_semi")
    texts = with_shingles(texts, "doc_shingles", width)
    asked = bounded_broadcast(pairs.select(F.col("id").alias("doc_key"), "item"), MAX_BROADCAST_ROWS)
    both = texts.join(asked, F.col("id").eqNullSafe(F.col("doc_key"))).join(bounded_broadcast(own, MAX_BROADCAST_ITEMS), F.col("item").eqNullSafe(F.col("item_key")))
    counted = both.select("id", "item", F.size("item_shingles").alias("n_item"), F.size(F.array_intersect("item_shingles", "doc_shingles")).alias("n_found"))
    return counted.where(F.col("n_found") >= F.lit(threshold) * F.col("n_item") - 1e-9)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and contained item: doc_id, item_id, n_item, n_found, containment."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    i = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    counted = _contained(d, i, threshold)
    best = counted.groupBy("id", "item").agg(F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("c"), "n_found", "n_item")).alias("m"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("m.n_item").cast("long").alias("n_item"),
        F.col("m.n_found").cast("long").alias("n_found"),
        F.round("m.c", 6).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose own text contains no item, all columns as they are.

    A row is known by its id and a hash of its text, so rows of one id, or without id, don't
    answer for each other.
    """
    key = lambda text: F.xxhash64(text)
    d = docs.select(F.struct(F.col(id_col).alias("id"), key(F.col(text_col)).alias("h")).alias("id"), F.col(text_col).alias("text"))
    i = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    bad = _contained(d, i, threshold).select("id").distinct().checkpoint()
    bad = bounded_broadcast(bad.select(F.struct("id.id", "id.h").alias("bad")), MAX_BROADCAST_ROWS).alias("found")
    mine = docs.alias("mine")
    return mine.join(bad, F.col(f"mine.{id_col}").eqNullSafe(F.col("found.bad.id")) & (key(F.col(f"mine.{text_col}")) == F.col("found.bad.h")), "left_anti")


ORACLE_SQL = r"""
with w as (select 'd' as k, doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
  union all select 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') from benchmark),
i as (select id, w, least(5, len(w)) as width from w where k = 'i' and len(w) > 0),
d as (select id, w, width from w, (select distinct width from i) where k = 'd' and len(w) >= width),
si as (select distinct id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda x: array_to_string(w[x:x + width - 1], ' '))) as s from i),
sd as (select distinct id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda x: array_to_string(w[x:x + width - 1], ' '))) as s from d),
n as (select id, count(*) as n from si group by id),
f as (select sd.id, si.id as item, count(*) as n_found from sd join si on sd.s = si.s and sd.width = si.width group by all)
select f.id as doc_id, f.item as item_id, n.n as n_item, n_found, round(n_found / n.n, 6) as containment
from f join n on f.item = n.id where n_found >= 0.8 * n.n - 1e-9"""
