"""Labelled text from templates and slot values, as a distributed job.

A template has parts p0 .. pn and slots s1 .. sn; an example is p0 v1 p1 v2 .. pn. Values and
templates are tables; which ones an id gets is a hash of seed, id and slot, so a run repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.frames import bounded_broadcast
from maskwright.functions.ranks import hash_rank

# Templates of our own: family, parts, slots.
TEMPLATES = (
    ("pe", ("Il signor ", " ha firmato il contratto."), ("pe",)),
    ("ind", ("La sede si trova in ", "."), ("ind",)),
    ("leg", ("Ricorso di ", " contro ", "."), ("pe", "org")),
    ("pro", ("", " lavora per ", " dal mese scorso."), ("pe", "org")),
    ("med", ("Referto: ", " segue una cura presso ", ""), ("pe", "org")),
    ("fin", ("Bonifico di ", " a favore di ", ""), ("org", "pe")),
)
#: Cases at span borders: punctuation, apostrophe, address, abbreviation, several entities, spaces.
BOUNDARY_TEMPLATES = (
    ("punctuation", ("(", "), presente."), ("pe",)),
    ("apostrophe", ("L'amico D'", " arriva."), ("pe",)),
    ("address", ("Spedire a ", ", scala B, ", "."), ("ind", "org")),
    ("abbreviation", ("Spett. ", " S.r.l., c.a. dott. ", "."), ("org", "pe")),
    ("several", ("", ", ", " e ", "!"), ("pe", "pe", "org")),
    ("spaces", ("Nome :  ", "   Ditta :  ", ""), ("pe", "org")),
)
#: Texts without personal data, and what may be put before and behind them.
NEGATIVES = ("Il contratto scade domani.", "La riunione inizia alle nove.", "Allegare la documentazione richiesta.", "Il server ha risposto con errore 500.")
PREFIXES, SUFFIXES = ("", "Nota: ", "Si ricorda che "), ("", " Grazie.", " Cordiali saluti.")
#: Words of a text for so many tokens.
WORDS_PER_TOKEN, TOKEN_BUCKETS = 1 / 1.3, (50, 100, 200, 400)


def pick(id_col: Column, salt: Column, n: Column) -> Column:
    """A number below n from a hash of salt and id."""
    digest = F.md5(F.concat_ws(":", salt, id_col.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n)


def templates(spark: SparkSession, rows: tuple = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, f, list(p), list(s)) for i, (f, p, s) in enumerate(rows)], "t long, family string, parts array<string>, slots array<string>")


def allocate_counts(weights: DataFrame, total: int, least: int = 0) -> DataFrame:
    """(family, n): a total shared out by weight, rounded down, at least ``least`` each."""
    whole = weights.agg(F.sum("weight").alias("_w"))
    share = F.floor(F.lit(total) * F.col("weight") / F.col("_w"))
    return weights.join(F.broadcast(whole), how="cross").select("family", F.greatest(share, F.lit(least)).cast("long").alias("n"))  # one row


def expand(ids: DataFrame, rows: tuple, values: DataFrame, seed: int = 42) -> DataFrame:
    """(id, family, text, entities (text, type, start, end)) of ids (id).

    ``values``: slot, v (0, 1, ... in each slot), value.
    """
    spark = ids.sparkSession
    table = templates(spark, rows)
    chosen = ids.select("id", pick(F.col("id"), F.lit(f"{seed}:t"), F.lit(len(rows))).alias("t")).join(F.broadcast(table), "t")
    sizes = values.groupBy("slot").agg(F.count(F.lit(1)).alias("_k"))
    slots = chosen.select("id", F.posexplode("slots").alias("i", "slot")).join(bounded_broadcast(sizes), "slot")
    slots = slots.withColumn("v", pick(F.col("id"), F.concat(F.lit(f"{seed}:s"), F.col("i").cast("string")), F.col("_k")))
    filled = slots.join(bounded_broadcast(values), ["slot", "v"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "value", "slot"))).alias("s"))
    both = chosen.join(filled, "id")
    kind = "array<struct<text:string,type:string,start:int,end:int>>"
    start = F.struct(F.get("parts", F.lit(0)).alias("text"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = F.length(a["text"])
        one = F.struct(x["value"].alias("text"), x["slot"].alias("type"), at.alias("start"), (at + F.length(x["value"])).alias("end"))
        return F.struct(F.concat(a["text"], x["value"], x["part"]).alias("text"), F.concat(a["out"], F.array(one)).alias("out"))

    zipped = F.transform("s", lambda x: F.struct(x["value"].alias("value"), x["slot"].alias("slot"), F.get(F.col("parts"), x["i"] + 1).alias("part")))
    return both.select("id", "family", F.aggregate(zipped, start, step).alias("m")).select("id", "family", F.col("m.text").alias("text"), F.col("m.out").alias("entities"))


def gendered(ids: DataFrame, relations: DataFrame, names: DataFrame, seed: int = 42) -> DataFrame:
    """(id, relation, name): a relation by hash, then a name of its gender.

    ``relations``: v, relation, gender; ``names``: gender, v (0, 1, ... in each gender), name.
    """
    n = relations.agg(F.count(F.lit(1)).alias("_n"))
    first = ids.join(F.broadcast(n), how="cross").select("id", pick(F.col("id"), F.lit(f"{seed}:r"), F.col("_n")).alias("v")).join(bounded_broadcast(relations), "v").drop("v")  # one row
    sizes = names.groupBy("gender").agg(F.count(F.lit(1)).alias("_k"))
    second = first.join(bounded_broadcast(sizes), "gender").withColumn("v", pick(F.col("id"), F.lit(f"{seed}:n"), F.col("_k")))
    return second.join(bounded_broadcast(names), ["gender", "v"]).select("id", "relation", "name")


def negative_expansion(negatives: DataFrame, prefixes: tuple[str, ...], suffixes: tuple[str, ...], count: int, seed: int = 42) -> DataFrame:
    """``count`` texts without personal data (no, text): hash-ordered texts if there are enough, else all
    and variations with affixes, whose texts start in lower case, in hash order."""
    affixes = F.array(*(F.struct(F.lit(a).alias("p"), F.lit(b).alias("s")) for a in prefixes for b in suffixes))
    all_ = negatives.select("no", "text", F.posexplode(affixes).alias("k", "x"))
    lower = F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))
    body = F.when(F.col("x.p") == "", F.col("text")).otherwise(lower)
    varied = all_.select(F.when(F.col("k") == 0, 0).otherwise(1).alias("tier"), F.concat_ws("-", "no", "k").alias("key"), F.concat("x.p", body, "x.s").alias("text"))
    plain = hash_rank(varied.where("tier = 0").withColumn("_all", F.lit(1)), ["_all"], "key", seed, "r")
    more = hash_rank(varied.where("tier = 1").withColumn("_all", F.lit(1)), ["_all"], "key", seed, "r")
    have = plain.agg(F.count(F.lit(1)).alias("_have"))
    extra = more.join(F.broadcast(have), how="cross").where(F.col("r") <= F.lit(count) - F.col("_have")).drop("_have")  # one row
    return plain.where(F.col("r") <= count).unionByName(extra).select("key", "text")


def length_bucket_inputs(fragments: DataFrame, buckets: tuple[int, ...] = TOKEN_BUCKETS) -> DataFrame:
    """(id, bucket, text): the words of a fragment, repeated as needed, cut to int(tokens / 1.3) words."""
    words = fragments.select("id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    each = words.select("id", "w", F.explode(F.array(*map(F.lit, buckets))).alias("bucket"))
    n = F.floor(F.col("bucket") * F.lit(WORDS_PER_TOKEN)).cast("int")
    many = F.flatten(F.array_repeat("w", F.ceil(n / F.size("w")).cast("int")))
    return each.select("id", "bucket", F.array_join(F.slice(many, F.lit(1), n), " ").alias("text"))
