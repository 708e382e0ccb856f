"""Near copies by word shingles: SimHash links and a lossless prefix search, then exact verification.

Texts are near copies if their sets of five-word shingles (words by white space, lower case; fewer
words make one shingle of all) have a Jaccard index of at least 0.8; texts of the same set are
copies, also those without words. Groups are the components of those links.

A radius of 2 bits finds about half of such texts, and one that finds all (some 18 bits of 64) would
make the blocks that shard the trees three bits wide, which shards nothing. So there are two rounds.

The first joins large families at little cost: SimHash with BK-trees (``simhash.hamming_links``), and
the least text of each of a text's ``BOTTOM`` smallest shingles. The second finds what is left and
loses nothing: a text's prefix is its first shingles in an order that is the same for all texts, as
many as it may miss at the threshold, plus one, so two near copies share a shingle of their prefixes.
Only prefix shingles that two groups of the first round share are looked at again. Where a shingle would make
many pairs, first single texts of its groups are compared, so that a text which the first round has left apart
from a large family joins it by a few pairs and not by one with each member; then all pairs of groups that are
still apart. Shingles that the very same texts share make the same pairs, so only one of them is looked at. Shingles
that a sample shows to be frequent come last in the order; the sample decides the cost only.

Texts are known by the number ``t`` of a row of the written table, so what is shuffled and joined is narrow; prefixes and
parities stay in the table and are read from it, once for each distinct text.

A pair is fetched for exact verification only if sizes and parities allow it. Each shingle flips one
bit of a text's parity, so two texts differ in at most as many bits as shingles.

Results by case: as ``simhash.keep_one``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from maskwright.llm.common import bounded_broadcast, ensure_checkpoint_dir, map_rows, packed, written
from maskwright.llm.simhash import SEED, components, hamming_links, keep_rows

WIDTH, THRESHOLD, RADIUS = 5, 0.8, 2
#: Smallest shingles of a text that the first round looks at.
BOTTOM = 8
#: A shingle in this many texts of the sample (one text in SAMPLE) is frequent; at most MAX_FREQUENT are kept.
SAMPLE, FREQUENT, MAX_FREQUENT = 16, 2, 100_000
#: Rows that may be broadcast, of at most 40 bytes.
MAX_BROADCAST_ROWS = 500_000
#: Shingles or row numbers (rows of 8 bytes) that may be broadcast.
MAX_BROADCAST_SHINGLES = 2_000_000
#: Rounds that join groups by single texts of them before all that is left is compared.
HEAD_ROUNDS = 2
#: Pairs of unlike groups a row that a shingle may make before it takes part in those rounds.
PAIRS_A_ROW = 4
#: Words of 64 bits of the parity that the second round's joins compare.
LANES = 8
_CHUNK = 100_000


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted 64-bit hashes."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) > width else [words]
    join = b" ".join
    return np.unique(np.fromiter((xxh64_intdigest(join(g), SEED) for g in grams), np.uint64))


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prefix(hashes: np.ndarray, frequent: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The first shingles of a set, frequent ones last."""
    size = len(hashes) - int(np.ceil(threshold * len(hashes) - 1e-9)) + 1
    if len(frequent) and len(hashes):
        often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    return hashes[: min(size, len(hashes))]


def parity(hashes: np.ndarray, size: int | None = None) -> bytes:
    """One bit for each residue of the hashes: whether an odd number of them has it. By default about as many bits as hashes."""
    size = size or max(64, 1 << (max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the length of the other."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, len(a)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def _apart(na: Column, nb: Column, threshold: float) -> Column:
    """Of the shingles of two texts, the most that near copies have in one only."""
    return F.lit((1 - threshold) / (1 + threshold)) * (na + nb) + 1e-6


def _possible(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow the threshold."""
    side = lambda k: prints.select(F.col("t").alias(k), F.col("n").alias("n" + k), F.col("parity").alias("p" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    both = both.select("a", "b", _apart(F.col("na"), F.col("nb"), threshold).alias("most"), "pa", "pb")

    def fn(batch: pa.RecordBatch):
        _, _, most, pa_, pb = (c.to_pylist() for c in batch.columns)
        near = pa.array([_differ(x, y) <= m for m, x, y in zip(most, pa_, pb, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return packed(map_rows(both, "a long, b long", fn))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def _sets(rows: DataFrame) -> DataFrame:
    """(t, hashes) of (t, text) rows."""

    def fn(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_hashes(_raw(t)) for t in batch.column(1).to_pylist()])], ["t", "hashes"])

    return map_rows(rows, "t long, hashes array<long>", fn)


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles met most often in a sample of the distinct texts."""
    some = texts.toDF("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    some = some.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"))
    counts = _sets(some.select(F.lit(0).cast("long").alias("t"), "text")).select(F.explode("hashes").alias("h")).groupBy("h").count()
    top = counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).select("h").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


_PRINTS = "key binary, n int, fp long, bottom array<long>, prefix array<long>, parity binary, lanes array<long>"


def _with_prints(rows: DataFrame, at: int, frequent: np.ndarray, threshold: float) -> DataFrame:
    """The rows with what the search needs of the text in column number ``at``; n is the number of shingles."""

    def fn(batch: pa.RecordBatch):
        sets = [shingle_hashes(_raw(t)) for t in batch.column(at).to_pylist()]
        columns = [
            pa.array([_key(s) for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int32()),
            pa.array([_fingerprint(s) for s in sets], pa.int64()),
            _lists([s[:BOTTOM] for s in sets]),
            _lists([prefix(s, frequent, threshold) for s in sets]),
            pa.array([parity(s) for s in sets], pa.binary()),
            _lists([np.frombuffer(parity(s, 64 * LANES), np.uint64) for s in sets]),
        ]
        names = [part.split()[0] for part in _PRINTS.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return map_rows(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + _PRINTS, fn)


def _one_each(table: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of the table, numbered ``row``, without those that repeat a key; ``least`` (key, t, c) has the number of
    each key's row that stays, and how many there are. The rows that go are few and broadcast, so what stays is read from
    the table whenever it is needed; beyond the bound it is written once.
    """
    again = table.select("key", "row").join(bounded_broadcast(least.where("c > 1").select("key", "t"), MAX_BROADCAST_ROWS), "key").where("row != t").select("row").checkpoint()
    prints = table.select("row", *(part.split()[0] for part in _PRINTS.split(", ")))
    if again.limit(MAX_BROADCAST_SHINGLES + 1).count() <= MAX_BROADCAST_SHINGLES:
        prints = prints.join(F.broadcast(again), "row", "left_anti")
    else:
        prints = written(prints.join(least.select(F.col("t").alias("row")), "row", "left_semi"), "near-copy-prints", "zstd")
    return prints.withColumnRenamed("row", "t")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of texts whose sets reach the threshold."""
    asked = packed(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    sets = _sets(texts.join(bounded_broadcast(asked, MAX_BROADCAST_ROWS), "t", "left_semi").select("t", "text")).checkpoint()
    side = lambda k: sets.select(F.col("t").alias(k), F.col("hashes").alias("h" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("both"))
    near = both.where(F.col("both") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("both")) - 1e-9).select("a", "b")
    return packed(near)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of pairs (x, y)."""
    return pairs.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def family_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """First round: texts of one fingerprint, fingerprints within the radius, and the texts of a bottom
    shingle with the least of them; at most BOTTOM + 2 pairs a text."""
    least = prints.groupBy("fp").agg(F.min("t").alias("y")).checkpoint()
    near = hamming_links(least.select("fp"), radius).distinct()
    side = lambda f, k: least.select(F.col("fp").alias(f), F.col("y").alias(k))
    near = near.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    same = prints.join(least, "fp").select(F.col("t").alias("x"), "y")
    rows = prints.select("t", F.explode("bottom").alias("h"))
    heads = rows.groupBy("h").agg(F.min("t").alias("y"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "y")
    return packed(_ordered(near.unionByName(same).unionByName(rows.join(heads, "h").select(F.col("t").alias("x"), "y"))))


def _grouped(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows with the group of their text by ``label`` (t, g); a text without one is its own."""
    return rows.drop("g").join(bounded_broadcast(label, MAX_BROADCAST_ROWS), "t", "left").withColumn("g", F.coalesce("g", "t"))


def _unlike_sets(rows: DataFrame) -> DataFrame:
    """The (h, t) rows of one shingle h for each set of texts: of those that the same texts share, the least."""
    digest = [F.bit_xor(F.xxhash64("t", F.lit(seed))).alias(f"d{seed}") for seed in (1, 2)]
    sets = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), *digest)
    least = sets.groupBy("c", "d1", "d2").agg(F.min("h").alias("h")).select("h").checkpoint()
    return rows.join(bounded_broadcast(least, MAX_BROADCAST_SHINGLES), "h")


def shared_shingles(prints: DataFrame, label: DataFrame) -> DataFrame:
    """(h, t, n, g, l0, l1, ...): the prefix shingles that texts of different groups share, one of those that the same
    texts share, with sizes and parity lanes."""
    grouped = _grouped(prints.select("t", "prefix"), label)
    mixed = grouped.select("g", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low != high").select("h").checkpoint()
    rows = prints.select("t", F.explode("prefix").alias("h")).join(bounded_broadcast(mixed, MAX_BROADCAST_SHINGLES), "h").checkpoint()
    rows = _unlike_sets(rows).join(prints.select("t", "n", "lanes"), "t")
    return _grouped(rows, label).select("h", "t", "n", "g", *(F.col("lanes")[i].alias(f"l{i}") for i in range(LANES))).checkpoint()


def _fits(threshold: float) -> Column:
    """Whether sizes and parity lanes of the rows ``x`` and ``y`` allow the threshold."""
    differ = sum((F.bit_count(F.col(f"x.l{i}").bitwiseXOR(F.col(f"y.l{i}"))) for i in range(1, LANES)), F.bit_count(F.col("x.l0").bitwiseXOR(F.col("y.l0"))))
    sizes = F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n") - 1e-9
    return sizes & (differ <= _apart(F.col("x.n"), F.col("y.n"), threshold))


def heavy_shingles(shared: DataFrame) -> DataFrame:
    """The rows of the shingles that make more than PAIRS_A_ROW pairs of unlike groups for each of their rows."""
    sizes = shared.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"))
    sums = sizes.groupBy("h").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("alike"))
    heavy = packed(sums.where(F.col("rows") * F.col("rows") - F.col("alike") > 2 * PAIRS_A_ROW * F.col("rows")).select("h"))
    return shared.join(bounded_broadcast(heavy, MAX_BROADCAST_ROWS), "h").select(*shared.columns).checkpoint()


def head_pairs(shared: DataFrame, seed: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of a round between groups: of each shingle one text of each group, by chance, with that of the
    shingle's largest group and that of another one. At most two pairs for each shingle and group."""
    rest = ["t", "n", *(f"l{i}" for i in range(LANES))]
    heads = shared.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("t", "h", F.lit(seed)).alias("by"), *rest)).alias("m"))
    heads = heads.select("h", "g", "c", *(F.col(f"m.{c}") for c in rest)).checkpoint()
    side = F.struct("g", *rest)
    two = heads.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max_by(side, F.struct("c", "g")).alias("big"), F.min_by(side, F.struct(F.xxhash64("g", F.lit(seed)), "g")).alias("any")).where("k > 1")
    two = two.select("h", F.explode(F.array("big", "any")).alias("y"))
    met = heads.alias("x").join(two, F.col("x.h") == two["h"]).where((F.col("x.g") != F.col("y.g")) & _fits(threshold))
    return _ordered(met.select(F.col("x.t").alias("x"), F.col("y.t").alias("y")))


def prefix_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """All texts of different groups that share a prefix shingle and whose sizes and parity lanes allow the threshold.

    Of two groups one is not the shingle's largest, so only texts of the others are compared with all: those of the
    largest do not meet each other.
    """
    sizes = shared.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"))
    top = sizes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "g")).alias("m")).where("k > 1").select("h", F.col("m.g").alias("top"))
    rows = shared.join(top, "h").checkpoint()
    x, y = rows.where("g != top").alias("x"), rows.alias("y")
    once = (F.col("y.g") == F.col("y.top")) | (F.col("x.t") < F.col("y.t"))
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.g") != F.col("y.g")) & once & _fits(threshold))
    return _ordered(met.select(F.col("x.t").alias("x"), F.col("y.t").alias("y")))


def copy_links(prints: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) of texts whose components are those of all near copies.

    ``prints`` has one row a distinct text (see ``_PRINTS``), numbered t; ``texts`` has its (t, text) among others.
    """
    verified = lambda pairs: _verified(_possible(pairs, prints, threshold), texts, threshold)
    group = lambda found: components(found).select(F.col("node").alias("t"), F.col("root").alias("g"))
    tried = family_pairs(prints, radius)
    links = verified(tried)
    label = group(links)
    shared = shared_shingles(prints, label)
    heavy = heavy_shingles(shared)
    for seed in range(HEAD_ROUNDS):
        if heavy.isEmpty():
            break
        pairs = packed(head_pairs(heavy, seed, threshold).join(tried, ["a", "b"], "left_anti"))
        more = verified(pairs)
        if more.isEmpty():
            break
        tried, links = tried.unionByName(pairs), links.unionByName(more)
        label = group(links)
        heavy = heavy_shingles(_grouped(heavy, label))
    rest = packed(prefix_pairs(_grouped(shared, label), threshold).join(tried, ["a", "b"], "left_anti"))
    return links.unionByName(verified(rest))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group stays: that of the smallest id (rows without id only where no other is).

    Of rows that share this id and shingle set one stays, that with the least hash of all its columns.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    at, id_at = docs.columns.index(text_col), f"c{docs.columns.index(id_col)}"
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    numbered = flat.withColumn("row", F.monotonically_increasing_id())
    table = written(_with_prints(numbered, at, frequent_shingles(flat.select(f"c{at}")), threshold), "near-copies", "zstd")
    rank = F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), "row")
    least = table.groupBy("key").agg(F.min(rank).alias("m"), F.count(F.lit(1)).alias("c")).select("key", F.col("m.row").alias("t"), "c").checkpoint()
    links = copy_links(_one_each(table, least), table.select(F.col("row").alias("t"), F.col(f"c{at}").alias("text")), threshold)
    roots = components(links).join(least, F.col("node") == F.col("t")).select("key", F.hex("root").cast("binary").alias("root"))
    return keep_rows(table, id_at, roots, MAX_BROADCAST_ROWS).toDF(*docs.columns)
