"""The token vault as an append-only table: (org_id, request_id, token_hash, encrypted,
created_at, expires_at). The newest row of a key counts; every key holds its org and request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.frames import bounded_broadcast
from maskwright.operators.tokens import decrypt

KEY = ["org_id", "request_id", "token_hash"]
#: Fixed value: most active tokens of an org.
MAX_ACTIVE = 10_000


def newest(vault: DataFrame) -> DataFrame:
    """The newest row of each key (a later upsert restarts the expiry)."""
    rest = [c for c in vault.columns if c not in KEY]
    best = vault.groupBy(*KEY).agg(F.max(F.struct("created_at", "expires_at", *(c for c in rest if c not in ("created_at", "expires_at")))).alias("m"))
    return best.select(*KEY, *(F.col(f"m.{c}").alias(c) for c in rest))


def upsert(vault: DataFrame, rows: DataFrame) -> DataFrame:
    return newest(vault.unionByName(rows))


def lookup(asked: DataFrame, vault: DataFrame, now: Column) -> DataFrame:
    """Every asked key with ``encrypted``, null where it is missing or has expired."""
    live = newest(vault).where(F.col("expires_at") > now)
    return asked.select(*KEY).join(live.select(*KEY, "encrypted"), KEY, "left")


def flush(vault: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vault without the requests (org_id, request_id), tokens removed for each; 0 if there were none)."""
    asked = requests.select("org_id", "request_id").distinct()
    held = newest(vault).groupBy("org_id", "request_id").agg(F.count(F.lit(1)).alias("n"))
    removed = asked.join(held, ["org_id", "request_id"], "left").select("org_id", "request_id", F.coalesce("n", F.lit(0)).alias("n_removed"))
    return vault.join(asked, ["org_id", "request_id"], "left_anti"), removed


def active_pairs(vault: DataFrame, now: Column) -> DataFrame:
    return newest(vault).where(F.col("expires_at") > now).select(*KEY).distinct()


def org_counts(vault: DataFrame, now: Column) -> DataFrame:
    return newest(vault).where(F.col("expires_at") > now).groupBy("org_id").agg(F.count(F.lit(1)).alias("n_active"))


def ttl(asked: DataFrame, vault: DataFrame, now: Column) -> DataFrame:
    """Whole seconds left of each asked key, -2 where it is missing or has expired."""
    left = F.unix_timestamp("expires_at") - F.unix_timestamp(now)
    live = newest(vault).where(F.col("expires_at") > now).select(*KEY, left.alias("ttl"))
    return asked.select(*KEY).join(live, KEY, "left").select(*KEY, F.coalesce("ttl", F.lit(-2)).alias("ttl"))


def purge(vault: DataFrame, now: Column) -> DataFrame:
    return vault.where(F.col("expires_at") > now)


def quota(orgs: DataFrame, vault: DataFrame, now: Column, limit: int = MAX_ACTIVE) -> DataFrame:
    """(org_id, n_active, reject_reason): an org with ``limit`` active tokens or more is refused."""
    n = F.coalesce("n_active", F.lit(0))
    joined = orgs.select("org_id").distinct().join(org_counts(vault, now), "org_id", "left")
    return joined.select("org_id", n.alias("n_active"), F.when(n >= limit, "token_quota_exceeded").alias("reject_reason"))


def rotate_keys(vault: DataFrame, old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Live rows under the new keys, with the time they had left.

    ``old`` and ``new``: org_id, dek. Rows that have expired or do not decrypt are left out, and
    so is an org without a new key. Write the vault first and the key table after it, so a
    failure between them loses nothing.
    """
    live = newest(vault).where(F.col("expires_at") > now)
    both = live.join(bounded_broadcast(old.select("org_id", F.col("dek").alias("_old"))), "org_id").join(bounded_broadcast(new.select("org_id", F.col("dek").alias("_new"))), "org_id")
    plain = both.withColumn("_plain", decrypt(F.col("encrypted"), F.col("_old"), F.col("org_id"))).where("_plain is not null")
    again = F.aes_encrypt(F.encode("_plain", "UTF-8"), "_new", F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("org_id").cast("string").cast("binary"))
    return plain.select(*KEY, again.alias("encrypted"), "created_at", "expires_at")


def commit_rotation(vault: DataFrame, old: DataFrame, new: DataFrame, now: Column, folder: str, version: int) -> int:
    """Rotate to new keys as one commit below ``folder``: first the vault under the new keys, then the key table,
    last a manifest that names both. Returns how many rows were encrypted again.

    Readers go by the newest manifest (``current_rotation``), so a job that stops before it leaves vault and keys of
    the version before in force, and is run again with the same version. An org with live rows and no new or old
    key is an error, before anything is written.
    """
    spark = vault.sparkSession
    orgs = newest(vault).where(F.col("expires_at") > now).select("org_id").distinct()
    for name, keys in (("old", old), ("new", new)):
        lone = orgs.join(bounded_broadcast(keys.select("org_id")), "org_id", "left_anti").limit(5).collect()
        if lone:
            raise ValueError(f"orgs without a key among the {name} ones: {sorted(str(r.org_id) for r in lone)}")
    rotate_keys(vault, old, new, now).write.mode("overwrite").parquet(f"{folder}/vault/version={version}")
    new.select("org_id", "dek").write.mode("overwrite").parquet(f"{folder}/keys/version={version}")
    n = spark.read.parquet(f"{folder}/vault/version={version}").count()
    spark.range(1).select(F.lit(n).alias("n_rotated")).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/version={version}")
    return n


def current_rotation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vault, keys) of the newest version whose manifest was written."""
    version = spark.read.schema("n_rotated long, version int").json(f"{folder}/manifest").where("n_rotated is not null").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/vault/version={version}"), spark.read.parquet(f"{folder}/keys/version={version}")
