"""Near-duplicate groups by SimHash fingerprints and BK-trees.

A fingerprint is 64 bits. Two fingerprints link when they differ in at most
``radius`` bits. Fingerprints are sharded by blocks: cut into ``radius + 2`` blocks,
two linked fingerprints agree on at least two whole blocks, so every pair of blocks
names a shard and linked fingerprints meet in one of them. The distinct
fingerprints of a shard form a BK-tree, whose children are keyed by their Hamming
distance to the parent; a search follows only the edges within the radius of the
distance it has measured. A shard's tree is sent to that shard's queries: shards of
more than ``shard_rows`` fingerprints are cut into that many parts, and each part of
the tree is sent to each part of the queries, so no task holds more than two parts.
A task returns, for each fingerprint, the smallest one that its links reach, never
all pairs. Components of those links come from alternating star rounds.

Results by case: a null or empty text, or one without words, has fingerprint zero and
links like any other; fewer than three words make one shingle of all words; repeated
rows give repeated results; a null id stays null and does not count for the smallest
id of a component (null if it has no other); empty tables give empty results; only
the id and text columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from maskwright.llm.common import PART_ROWS, bounded_broadcast, ensure_checkpoint_dir, ensure_importable, map_rows, written

SHINGLE, SEED, RADIUS, SHARD_ROWS = 3, 42, 2, 20_000
#: Hashes that are turned into bits at once.
_CHUNK = 100_000


def fingerprint(raw: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: bytes.lower and bytes.split know ASCII only, as wanted."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    join = b" ".join
    grams = zip(*(words[i:] for i in range(width)), strict=False)
    counts, total = np.zeros(64, np.int64), 0
    while part := [xxh64_intdigest(join(g), seed) for g in itertools.islice(grams, _CHUNK)]:
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with a signed 64-bit column ``name`` added (one of that name is replaced)."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    fields = docs.withColumn(name, F.lit(0).cast("long")).schema

    def fn(batch: pa.RecordBatch):
        prints = np.array([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, name])

    return map_rows(docs, fields, fn)


class BKTree:
    """BK-tree of distinct 64-bit values; build and search work on many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        todo, parent = np.arange(1, len(values)), np.zeros(max(0, len(values) - 1), np.int64)
        while len(todo):
            edge = np.bitwise_count(values[todo] ^ values[parent]).astype(np.int64)
            slot = parent * 65 + edge
            _, first = np.unique(slot, return_index=True)  # the first value on an edge becomes its child
            self.child.reshape(-1)[slot[first]] = todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, parent = todo[rest], self.child.reshape(-1)[slot[rest]].astype(np.int64)

    def search(self, queries: np.ndarray, radius: int, width: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (query index, value index) pairs within the radius."""
        if not len(self.values):
            return
        stack = [(np.arange(i, min(i + width, len(queries))), None) for i in range(0, len(queries), width)]
        while stack:
            q, node = stack.pop()
            node = np.zeros(len(q), np.int64) if node is None else node
            if len(q) > width:
                stack += [(q[i : i + width], node[i : i + width]) for i in range(0, len(q), width)]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            nq, nn = [], []
            for step in range(-radius, radius + 1):
                edge = d + step
                ok = np.flatnonzero((edge > 0) & (edge <= 64))
                kid = self.child[node[ok], edge[ok]]
                has = kid >= 0
                nq.append(q[ok[has]])
                nn.append(kid[has].astype(np.int64))
            q, node = np.concatenate(nq), np.concatenate(nn)
            if len(q):
                stack.append((q, node))


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels of linked members until both ends of every link agree."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]


def shard_links(tree_values: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value that its links in this shard reach), only where they differ.

    ``queries`` is None when the tree is searched for its own values.
    """
    values = np.unique(tree_values if queries is None else np.concatenate([tree_values, queries]))
    label = np.arange(len(values))
    tree = BKTree(np.unique(tree_values))
    own = np.searchsorted(values, tree.values)
    asked = tree.values if queries is None else np.unique(queries)
    place = own if queries is None else np.searchsorted(values, asked)
    held, size = [], 0
    for q, v in tree.search(asked, radius):
        a, b = place[q], own[v]
        keep = a != b
        held.append((a[keep], b[keep]))
        size += int(keep.sum())
        if size > 2_000_000:  # fold what has been found, so that links never pile up
            _fold(label, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        _fold(label, *(np.concatenate(x) for x in zip(*held, strict=True)))
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def hamming_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, col: str = "fp") -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius.

    ``prints`` has distinct signed 64-bit values. At most one link a value and shard.
    """
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for pair in itertools.combinations(range(blocks), 2):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in pair)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(len(keys)).cast("byte").alias("b"), F.col(col).bitwiseAND(F.lit(signed)).alias("k")))
    rows = prints.select(F.col(col).alias("fp"), F.explode(F.array(*keys)).alias("s")).select("fp", "s.b", "s.k")
    sizes = rows.groupBy("b", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["b", "k"])  # a shard of one has no links
    parts = F.ceil(F.col("n") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # side 0: part of the tree, once for each part of the queries; side 1: queries, for each part of the tree.
    # With one part both are the same rows and only side 0 is sent.
    rows = rows.withColumn("parts", parts).withColumn("own", own)
    spread = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("q"), F.lit(0).alias("side")))).otherwise(
        F.flatten(
            F.array(
                F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("own").alias("t"), j.alias("q"), F.lit(0).alias("side"))),
                F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("t"), F.col("own").alias("q"), F.lit(1).alias("side"))),
            )
        )
    )
    rows = rows.select("fp", "b", "k", F.explode(spread).alias("x")).select("b", "k", "x.t", "x.q", "fp", "x.side")
    rows = rows.repartition("b", "k", "t", "q").sortWithinPartitions("b", "k", "t", "q", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            out_a, out_b = [], []
            edge = np.flatnonzero((block[1:, :4] != block[:-1, :4]).any(1)) + 1
            for part in np.split(block, edge):
                v, side = part[:, 4].view(np.uint64), part[:, 5]
                a, b = shard_links(v[side == 0], v[side == 1] if side.any() else None, radius)
                out_a.append(a)
                out_b.append(b)
            a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack([np.asarray(batch.column(i).cast(pa.int64())) for i in range(6)], 1)
            held.append(m)
            if (m[-1, :4] == held[0][0, :4]).all():
                continue  # one shard goes on
            block = np.concatenate(held)
            cut = len(block) - 1
            changed = np.flatnonzero((block[:, :4] != block[-1, :4]).any(1))
            cut = changed[-1] + 1
            yield from flush(np.ascontiguousarray(block[:cut]))
            held = [block[cut:]]
        if held:
            yield from flush(np.ascontiguousarray(np.concatenate(held)))

    ensure_importable(rows.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (a, b); nodes without links are absent.

    Alternating large-star and small-star rounds until nothing changes, which takes about the
    logarithm of the longest chain; the rows of a round are at most the links, each round is cut
    off by a checkpoint in the shared folder. A node with very many links is a hot key of plain
    inner joins only, which adaptive execution splits. A round shuffles some six times, and each part of a
    shuffle's input writes files of its own, so the parts are one more than PART_ROWS goes into the links.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().checkpoint()
    parts, state = edges.count() // PART_ROWS + 1, None
    edges = edges.coalesce(parts)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").coalesce(parts).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = small.where("u != v").distinct().coalesce(parts).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_roots(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, id, root, component_id) for each distinct fingerprint of ``prints`` (fp, id).

    id is the smallest id with that fingerprint, component_id that of the component.
    """
    distinct = prints.groupBy("fp").agg(F.min("id").alias("id"))
    ensure_checkpoint_dir(prints.sparkSession)
    distinct = distinct.checkpoint()
    found = components(hamming_links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "id", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = with_fingerprint(rows, "text", "fp").select("doc_id", "fp").checkpoint()
    roots = fingerprint_roots(prints.select("fp", F.col("doc_id").alias("id")), radius).select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(roots, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_rows(table: DataFrame, id_col: str, roots: DataFrame, max_broadcast: int) -> DataFrame:
    """The kept rows of a table that has a ``key`` and columns c0, c1, ...: one of each group of keys.

    ``roots`` (key, root) names the group of linked keys; any other key is a group of its own. The row
    of the smallest id stays (one without id only where no other is; of equal ids that of the least key,
    then of the least hash of all columns). Only keys with more rows or links than one are looked up, so
    most rows pass by without a shuffle.
    """
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    per = table.groupBy("key", id_col).agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.min(F.struct(rank.alias("id"), "c")).alias("m"), F.sum("c").alias("rows"))
    per = per.join(roots, "key", "left").where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "key"))
    best = F.min(F.struct(F.col("m.id").alias("id"), "key"))
    groups = per.groupBy("root").agg(best.alias("best"))
    asked = per.join(groups, "root").select("key", (F.col("key") == F.col("best.key")).alias("first"), F.col("best.id.id").alias("kept_id"), (F.col("m.c") > 1).alias("again")).checkpoint()
    columns = [c for c in table.columns if c[0] == "c" and c[1:].isdigit()]
    looked = table.select("key", *columns).join(bounded_broadcast(asked, max_broadcast), "key", "left")
    own = F.col("first") & F.col(id_col).eqNullSafe(F.col("kept_id"))
    kept = looked.where(F.col("first").isNull() | (own & ~F.col("again"))).select(*columns)
    again = asked.where("first and again").select("key", "kept_id")
    if not again.limit(1).count():
        return kept
    plain = [c for c, kind in table.select(*columns).dtypes if "map<" not in kind]
    rows = table.select("key", *columns).join(bounded_broadcast(again, max_broadcast), "key").where(F.col(id_col).eqNullSafe(F.col("kept_id")))
    return kept.unionByName(rows.groupBy("key").agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias("m")).select("m.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group stays: that of the smallest id (rows without id only where no other is).

    Of rows that share this id and fingerprint one stays, that with the least hash of all its columns.
    """
    at, id_at = docs.columns.index(text_col), f"c{docs.columns.index(id_col)}"
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    table = written(with_fingerprint(flat, f"c{at}", "key"), "simhash")
    links = hamming_links(table.select("key").distinct(), radius, col="key")
    return keep_rows(table, id_at, components(links).select(F.col("node").alias("key"), "root"), SHARD_ROWS * 25).toDF(*docs.columns)
