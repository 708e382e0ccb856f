"""Reversible tokens: keyed hashes, collisions, encryption, rewriting and its inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.frames import bounded_broadcast, materialise
from maskwright.functions.ranks import join_by
from maskwright.functions.patterns import TOKEN, TOKEN_TYPES
from maskwright.operators.detect import detect, fuse

#: Digits of a token hash, most suffixes of one hash, limits of a request.
HASH_DIGITS, MAX_SUFFIX = 8, 10
MAX_TEXTS, MAX_CHARS = 100, 10_000
#: Most carried tokens of a request, longest carried value and token.
MAX_CARRIED, CARRIED_CHARS = 1_000, (512, 128)


def key_pads(keys: DataFrame, key_col: str = "dek", block: int = 64) -> DataFrame:
    """Add ``ipad`` and ``opad`` (binary) for HMAC-SHA256; keys have at most ``block`` bytes.

    Keys travel as columns of a key table, so that no key is a literal of a plan.
    """
    digits = F.rpad(F.hex(key_col), block * 2, "0")

    def pad(byte: int) -> Column:
        nibbles = F.transform(F.sequence(F.lit(1), F.lit(block * 2)), lambda i: i)
        high, low = f"{byte:02x}"
        mixed = F.transform(
            nibbles,
            lambda i: F.lower(F.hex(F.conv(F.substring(F.col("_d"), i, F.lit(1)), 16, 10).cast("int").bitwiseXOR(F.when(i % 2 == 1, int(high, 16)).otherwise(int(low, 16))).cast("long"))),
        )
        return F.unhex(F.array_join(mixed, ""))

    return keys.withColumn("_d", digits).withColumn("ipad", pad(0x36)).withColumn("opad", pad(0x5C)).drop("_d")


def hmac_hash(value: Column, ipad: Column, opad: Column, digits: int = HASH_DIGITS) -> Column:
    """The first hex digits of HMAC-SHA256 of a string."""
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(opad, inner), 256), 1, digits)


def format_token(pii_type: Column, digest: Column) -> Column:
    """The token, null where the type or the hash is not valid."""
    good = pii_type.isin(*TOKEN_TYPES) & digest.rlike(r"^[a-f0-9]{4,8}(_\d+)?$")
    return F.when(good, F.concat(F.lit("[#"), pii_type, F.lit(":"), digest, F.lit("]")))


def parse_token(token: Column) -> Column:
    """(pii_type, hash) of a string that is a token of a known type as a whole, else null."""
    whole = f"^{TOKEN}$"
    kind = F.regexp_extract(token, whole, 1)
    return F.when(kind.isin(*TOKEN_TYPES), F.struct(kind.alias("pii_type"), F.regexp_extract(token, whole, 2).alias("hash")))


def is_token(token: Column) -> Column:
    return F.coalesce(parse_token(token).isNotNull(), F.lit(False))


def find_tokens(text: Column) -> Column:
    """Tokens of known types with offsets: (start, end, text, pii_type, hash)."""
    found = F.transform(
        S.find_all(text, TOKEN, r"\[#"),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.regexp_extract(m["text"], TOKEN, 1).alias("pii_type"), F.regexp_extract(m["text"], TOKEN, 2).alias("hash")),
    )
    return F.filter(found, lambda m: m["pii_type"].isin(*TOKEN_TYPES))


def _number(n: Column) -> Column:
    """The hash of the n-th slot of a base hash: itself, then with ``_2`` to ``_10``."""
    return F.when(n == 1, F.col("base_hash")).when(n <= MAX_SUFFIX, F.concat("base_hash", F.lit("_"), n.cast("string")))


def allocate(first: DataFrame, by: list[str], prior: DataFrame | None = None) -> DataFrame:
    """Add ``hash`` to the distinct values of requests: the first slot of its base hash that is free or its own.

    ``first``: ``by``, value, base_hash, place (order of first appearance; one row for a value). ``prior``:
    ``by``, value, hash, the slots that are taken already. Values take slots in the order of their places,
    each the first free one, and a carried value its own slot if no free one comes before it; a taken slot
    is never given to another value. Of several values carried with one hash the greatest owns it. The
    hash is null where all MAX_SUFFIX slots are taken.
    """
    w = Window.partitionBy(*by, "base_hash").orderBy("place", "value")
    if prior is None:
        return first.withColumn("hash", _number(F.row_number().over(w)))
    base = F.substring_index("hash", "_", 1)
    slot = F.when(F.col("hash") == base, 1).otherwise(F.expr("try_cast(substring_index(hash, '_', -1) as int)"))
    owned = prior.select(*by, "value", "hash", base.alias("base_hash"), slot.alias("own")).where(F.col("hash") == F.coalesce(_number(F.col("own")), F.lit("")))
    owners = owned.groupBy(*by, "base_hash", "own").agg(F.max("value").alias("value"))
    taken = owners.groupBy(*by, "base_hash").agg(F.array_sort(F.collect_set("own")).alias("_taken"))  # at most MAX_SUFFIX
    lowest = owners.groupBy(*by, "base_hash", "value").agg(F.min("own").alias("_own"))
    met = join_by(join_by(first, taken, [*by, "base_hash"], "left"), lowest, [*by, "base_hash", "value"], "left")
    alone = met.where("_taken is null").drop("_taken", "_own").withColumn("hash", _number(F.row_number().over(w)))
    # in a group with taken slots only the owners and the first values without one can get a slot
    rank = F.row_number().over(Window.partitionBy(*by, "base_hash", F.col("_own").isNull()).orderBy("place", "value"))
    ranked = met.where("_taken is not null").withColumn("_n", rank)
    able = F.col("_own").isNotNull() | (F.col("_n") <= MAX_SUFFIX)
    free = F.array_except(F.sequence(F.lit(1), F.lit(MAX_SUFFIX)), F.first("_taken"))
    groups = ranked.where(able).groupBy(*by, "base_hash").agg(free.alias("_free"), F.array_sort(F.collect_list(F.struct("place", "value", "_own"))).alias("_values"))
    none = F.array().cast("array<struct<value:string,slot:int>>")

    def step(acc: Column, x: Column) -> Column:
        open_ = F.try_element_at(acc["free"], F.lit(1))
        take = F.coalesce(open_ < x["_own"], open_.isNotNull() & x["_own"].isNull())
        given = F.concat(acc["given"], F.array(F.struct(x["value"].alias("value"), F.when(take, open_).otherwise(x["_own"]).alias("slot"))))
        return F.struct(F.when(take, F.slice(acc["free"], 2, MAX_SUFFIX)).otherwise(acc["free"]).alias("free"), given.alias("given"))

    given = F.aggregate("_values", F.struct(F.col("_free").alias("free"), none.alias("given")), step, lambda acc: acc["given"])
    placed = groups.select(*by, "base_hash", F.explode_outer(given).alias("g")).select(*by, F.col("g.value").alias("value"), "base_hash", _number(F.col("g.slot")).alias("hash"))
    mixed = join_by(ranked.drop("_taken", "_own", "_n"), placed, [*by, "value", "base_hash"], "left")
    return alone.unionByName(mixed)


def resolve_collisions(values: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Give every distinct value of a request its hash (see ``allocate``).

    ``values``: request_id, value, base_hash, place. ``prior``: request_id, value, hash, carried over from
    earlier calls. The result adds hash, null with ``failed`` beyond MAX_SUFFIX values.
    """
    first = values.groupBy("request_id", "value", "base_hash").agg(F.min("place").alias("place"))
    done = allocate(first, ["request_id"], prior)
    return done.select("request_id", "value", "base_hash", "place", "hash", F.col("hash").isNull().alias("failed"))


def is_uuid(text: Column) -> Column:
    """Whether a string is a UUID: 32 hex digits, with hyphens, braces or a URN prefix or without."""
    bare = F.regexp_replace(F.btrim(F.regexp_replace(text, "urn:|uuid:", ""), F.lit("{}")), "-", "")
    return F.coalesce(bare.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def validate_requests(rows: DataFrame, max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS, prior: DataFrame | None = None, max_carried: int = MAX_CARRIED, uuids: bool = False) -> DataFrame:
    """Add ``reject_reason`` to (request_id, text) rows, null where a row is admitted. Only the requests
    with too many texts, or at fault in what they carry over, are looked up.

    ``prior``: request_id, value, token, the tokens that requests carry over; a request with over
    ``max_carried`` of them, or with a value or token that is too long, is refused. With ``uuids``
    the ids must be UUIDs, those of ``org_id`` too where there is such a column.
    """
    full = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_texts)
    rows = join_by(rows, bounded_broadcast(full), ["request_id"], "left")
    reason = F.when(F.lit(False), "")
    if uuids:
        ids = [c for c in ("org_id", "request_id") if c in rows.columns]
        for c in ids:
            reason = reason.when(~is_uuid(F.col(c)), f"invalid_{c}")
    reason = reason.when(F.col("text").isNull(), "missing_text").when(F.length("text") > max_chars, "text_too_long").when(F.col("_n").isNotNull(), "too_many_texts")
    if prior is not None:
        long = F.coalesce((F.length("value") > CARRIED_CHARS[0]) | (F.length("token") > CARRIED_CHARS[1]), F.lit(False))
        fault = prior.groupBy("request_id").agg(F.count(F.lit(1)).alias("k"), F.max(long.cast("int")).alias("long"))
        fault = fault.select("request_id", F.when(F.col("k") > max_carried, "too_many_carried").when(F.col("long") == 1, "carried_too_long").alias("_fault")).where("_fault is not null")
        rows = join_by(rows, bounded_broadcast(fault), ["request_id"], "left")
        reason = reason.when(F.col("_fault").isNotNull(), F.col("_fault"))
    return rows.withColumn("reject_reason", reason).drop("_n", "_fault")


_SCOPE = ["org_id", "request_id"]


def _rewritten(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` (_row, text, ...) with ``_ranges``: the ranges (_row, start, end, new) of each text in their order."""
    per_row = ranges.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_ranges"))
    return rows.join(per_row, "_row", "left")


def _refused(docs: DataFrame, keys: DataFrame, quota: DataFrame | None) -> DataFrame:
    """Add ``reject_reason``: the refusal of the org's quota, else ``no_key`` for an org without a key."""
    known = bounded_broadcast(keys.select("org_id", F.lit(True).alias("_known")).distinct())
    reason = F.when(F.col("_known").isNull(), "no_key")
    docs = join_by(docs, known, ["org_id"], "left")
    if quota is not None:
        docs = join_by(docs, bounded_broadcast(quota.where("reject_reason is not null").select("org_id", F.col("reject_reason").alias("_quota"))), ["org_id"], "left")
        reason = F.coalesce("_quota", reason)
    return docs.withColumn("reject_reason", reason).drop("_known", "_quota")


def tokenize(
    docs: DataFrame,
    keys: DataFrame,
    spans_col: str | None = None,
    digits: int = HASH_DIGITS,
    prior: DataFrame | None = None,
    turn_col: str = "doc_id",
    quota: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replace every detected value by a token.

    ``docs``: doc_id, org_id, request_id, text, and ``turn_col``, the order of a request's texts. ``keys``:
    org_id, dek, ipad, opad. ``prior``: org_id, request_id, value, hash, tokens carried over from earlier
    turns: their values keep them, and no new value takes one (see ``allocate``). ``quota``: org_id,
    reject_reason, orgs that are refused before anything is detected.

    Returns (tokenized: doc_id, tokenized, n_spans, reject_reason; entries: one row per request and
    distinct value with token, hash and value). It fails closed: a text comes back null, with a reason, if
    its org is refused or has no key (``no_key``), or if a value of its request has no token, over ten
    collisions or a type or hash that no token may have (``no_token``); such requests have no entries.
    Texts without a span skip the shuffles. Rows are told apart by a number of their own, so ids may
    repeat; a null request is a request.
    """
    spans = spans_col or "spans"
    asked = _refused(docs.select(*dict.fromkeys(["doc_id", *_SCOPE, "text", turn_col, *([spans_col] if spans_col else [])])), keys, quota)
    admitted = asked.where("reject_reason is null")
    found = materialise((admitted if spans_col else fuse(detect(admitted))).withColumn("_row", F.monotonically_increasing_id()))
    some = F.coalesce(F.size(spans), F.lit(0)) > 0
    rows = found.where(some)
    long = rows.select("_row", F.col(turn_col).alias("_turn"), *_SCOPE, F.explode_outer(spans).alias("s"))
    pads = bounded_broadcast(keys.select("org_id", "ipad", "opad"))
    value = F.col("s.text")
    hashed = join_by(long, pads, ["org_id"]).select(
        "_row", "_turn", *_SCOPE, value.alias("value"), "s.pii_type", "s.start", "s.end", hmac_hash(value, F.col("ipad"), F.col("opad"), digits).alias("base_hash")
    )
    first = hashed.groupBy(*_SCOPE, "value", "base_hash").agg(F.min(F.struct(F.struct("_turn", "start").alias("place"), "pii_type")).alias("m"))
    first = first.select(*_SCOPE, "value", "base_hash", F.col("m.place").alias("place"), F.col("m.pii_type").alias("pii_type"))
    entries = allocate(first, _SCOPE, prior)
    entries = materialise(entries.withColumn("token", format_token(F.col("pii_type"), F.col("hash"))))
    failed = bounded_broadcast(entries.where("token is null").select(*_SCOPE, F.lit("no_token").alias("reject_reason")).distinct())
    named = join_by(hashed.select("_row", *_SCOPE, "value", "start", "end"), entries.select(*_SCOPE, "value", F.col("token").alias("new")), [*_SCOPE, "value"])
    made = _rewritten(rows, named.where("new is not null").select("_row", "start", "end", "new"))
    made = made.select("doc_id", *_SCOPE, S.replace_ranges(F.col("text"), F.col("_ranges"), lambda x: x["new"]).alias("tokenized"), F.size(spans).cast("long").alias("n_spans"))
    rest = found.where(~some).select("doc_id", *_SCOPE, F.col("text").alias("tokenized"), F.lit(0).cast("long").alias("n_spans"))
    text = join_by(made.unionByName(rest), failed, _SCOPE, "left")
    text = text.select("doc_id", F.when(F.col("reject_reason").isNull(), F.col("tokenized")).alias("tokenized"), "n_spans", "reject_reason")
    refused = asked.where("reject_reason is not null").select("doc_id", F.lit(None).cast("string").alias("tokenized"), F.lit(0).cast("long").alias("n_spans"), "reject_reason")
    entries = join_by(entries, failed.select(*_SCOPE), _SCOPE, "left_anti")
    return text.unionByName(refused), entries.select(*_SCOPE, "hash", "token", "pii_type", "value")


def encrypt_values(entries: DataFrame, keys: DataFrame, created_at: Column, ttl_seconds: int = 60) -> DataFrame:
    """Vault rows of token entries: the value under the org's key, bound to the org.

    AES-GCM draws a new nonce each time it runs, so write the rows once and read them back.
    """
    joined = entries.where("hash is not null").join(bounded_broadcast(keys.select("org_id", "dek")), "org_id")
    secret = F.aes_encrypt(F.encode("value", "UTF-8"), "dek", F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("org_id").cast("string").cast("binary"))
    return joined.select("org_id", "request_id", F.col("hash").alias("token_hash"), secret.alias("encrypted"), created_at.alias("created_at"), (created_at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def decrypt(encrypted: Column, dek: Column, org: Column) -> Column:
    """The value, null where key, org or content do not fit."""
    return F.decode(F.try_aes_decrypt(encrypted, dek, F.lit("GCM"), F.lit("DEFAULT"), org.cast("string").cast("binary")), "UTF-8")


def wrap_keys(orgs: DataFrame, existing: DataFrame, kek: DataFrame) -> DataFrame:
    """(org_id, encrypted_dek) of orgs (org_id, dek, created_at) that have no key; the first writer wins.
    ``kek`` is one row with a column ``kek``."""
    new = orgs.join(existing.select("org_id"), "org_id", "left_anti")
    first = new.groupBy("org_id").agg(F.min_by("dek", F.struct("created_at", "dek")).alias("dek"))
    return first.join(F.broadcast(kek.limit(1)), how="cross").select("org_id", F.aes_encrypt("dek", "kek", F.lit("GCM")).alias("encrypted_dek"))


def rehydrate(docs: DataFrame, vault: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Put values back: (doc_id, text, n_restored) of (doc_id, org_id, request_id, text).

    Tokens that are unknown, expired or do not decrypt stay. Texts without a token skip the shuffles.
    """
    tokens = find_tokens(F.coalesce("text", F.lit("")))
    found = materialise(docs.select("doc_id", *_SCOPE, "text", tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_row")))
    rows = found.where(F.size("_tokens") > 0)
    long = rows.select("_row", *_SCOPE, F.explode_outer("_tokens").alias("m")).select("_row", *_SCOPE, "m.start", "m.end", F.col("m.hash").alias("token_hash"))
    key = [*_SCOPE, "token_hash"]
    newest = vault.where(F.col("expires_at") > now).groupBy(*key).agg(F.max_by("encrypted", "created_at").alias("encrypted"))
    known = join_by(newest, long.select(*key).distinct(), key, "left_semi").join(bounded_broadcast(keys.select("org_id", "dek")), "org_id")
    known = known.select(*key, decrypt(F.col("encrypted"), F.col("dek"), F.col("org_id")).alias("new")).where("new is not null")
    made = _rewritten(rows, join_by(long, known, key).select("_row", "start", "end", "new"))
    restored = F.coalesce(F.size("_ranges"), F.lit(0)).cast("long")
    text = made.select("doc_id", S.replace_ranges(F.col("text"), F.col("_ranges"), lambda x: x["new"]).alias("text"), F.greatest(restored, F.lit(0)).alias("n_restored"))
    return text.unionByName(found.where(F.size("_tokens") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_restored")))
