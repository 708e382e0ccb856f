"""URL filter: a blocked Bloom filter in front of an exact hash join, and host/path rules.

The filter has blocks of 256 bits in four lanes; a key sets two bits in each lane of
one block. It is a table (block, four lanes) made by ``bit_or`` and joined by block,
broadcast only while its known number of blocks is small. Possible hits go on to an
exact hash join with the list, all other rows end there. While filter and list are small
enough to be broadcast the pages are read once and never shuffled. Beyond that the probed
rows are written once; rows that cannot be listed go to blocks of no key, spread by hash, and
hot urls are a key of plain joins, which adaptive execution splits.

Results by case: a null url, or one without ``://``, has an empty host and path, fits
no rule and is never listed; repeated rows give repeated results; an empty list blocks
nothing; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ensure_checkpoint_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES, BLOCK_BITS, BITS_PER_KEY = 4, 256, 16
#: Blocks, and listed urls, that may be broadcast: about 10 and 20 MB of rows.
MAX_BROADCAST_BLOCKS, MAX_BROADCAST_KEYS = 200_000, 200_000
#: Blocks of no key, for rows that cannot be listed.
SPREAD = 1_024
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns; both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without www. and default port, path without a last slash or index page, sorted
    parameters without tracking ones; empty where there is no host."""
    host, path = split_url(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path, r"/(index\.html?)?$", "")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    drop = lambda p: (p == "") | F.startswith(p, F.lit(TRACKING[0])) | F.startswith(p, F.lit(TRACKING[1])) | F.startswith(p, F.lit(TRACKING[2])) | F.startswith(p, F.lit(TRACKING[3]))
    query = F.array_join(F.array_sort(F.filter(query, lambda p: ~drop(p))), "&")
    return F.when(host == "", "").otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, nulls where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    name = verdict = None
    for r in ordered:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _lanes(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("lanes"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(LANES)]


def build_filter(keys: DataFrame, col: str, n_keys: int) -> tuple[DataFrame, int]:
    """(block, lane0 .. lane3) of the distinct keys, and the number of blocks."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    lanes = keys.select(_block(F.col(col), blocks).alias("block"), *(x.alias(f"lane{i}") for i, x in enumerate(_lanes(F.col(col)))))
    return lanes.groupBy("block").agg(*(F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES))), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, canonical, rule, listed, verdict.

    ``listed`` has urls in ``list_col``; they are made canonical here.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    keys = listed.select(canonical_url(F.col(list_col)).alias("key")).where("key != ''").distinct().checkpoint()  # read three times
    n_keys = keys.count()
    bloom, blocks = build_filter(keys, "key", n_keys)
    small = blocks <= MAX_BROADCAST_BLOCKS and n_keys <= MAX_BROADCAST_KEYS
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical_url(F.col(url_col)).alias("canonical"))
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("rule_verdict"))
    wants = F.lit(True)
    for i, lane in enumerate(_lanes(F.col("canonical"))):
        wants = wants & (F.col(f"lane{i}").bitwiseAND(lane) == lane)
    block = F.when(F.col("canonical") != "", _block(F.col("canonical"), blocks)).otherwise(-1 - F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)))
    probed = rows.withColumn("block", block).join(F.broadcast(bloom) if small else bloom, "block", "left")
    probed = probed.select(*rows.columns, F.coalesce(wants, F.lit(False)).alias("maybe"))
    exact = keys.select(F.col("key").alias("hit"))
    if small:
        possible = F.when(F.col("maybe"), F.col("canonical"))
        judged = probed.join(F.broadcast(exact), possible == F.col("hit"), "left").withColumn("listed", F.col("hit").isNotNull())
    else:
        probed = written(probed, "urls")
        hits = probed.where("maybe").join(exact, F.col("canonical") == F.col("hit"), "left").withColumn("listed", F.col("hit").isNotNull()).drop("hit")
        judged = probed.where(~F.col("maybe")).withColumn("listed", F.lit(False)).unionByName(hits)
    return judged.select(
        "page_id",
        "host",
        "path",
        "canonical",
        "rule",
        "listed",
        F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def campaign_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list of the registered query: urls that were reached through a campaign link
    (utm parameters) or lie on a host with a label that starts with "spam"."""
    host, _ = split_url(F.col(url_col))
    return pages.where(F.contains(F.col(url_col), F.lit("utm_")) | host.rlike(r"(^|\.)spam")).select(F.col(url_col).alias("url"))


ORACLE_SQL = r"""
with p as (select page_id, coalesce(url, '') as u,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
s as (select page_id, u, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' and not starts_with(x, 'utm_') and not starts_with(x, 'ref=') and not starts_with(x, 'fbclid=') and not starts_with(x, 'gclid='))), '&') as q from p),
c as (select *, case when host = '' then '' else
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/(index\.html?)?$', '')
    || case when q = '' then '' else '?' || q end end as canonical from s),
l as (select distinct canonical from c where canonical <> '' and (contains(u, 'utm_') or regexp_matches(host, '(^|\.)spam'))),
r as (select c.*, l.canonical is not null as listed,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from c left join l on c.canonical = l.canonical)
select page_id, host, path, canonical, rule, listed,
  case when rule in ('example.com/de/', 'net/') then 'block' when rule is not null then 'allow'
    when listed then 'block' else 'allow' end as verdict from r"""
