"""URL verdicts: ordered host and path rules, then a Bloom filter cascade over listed addresses.

Level 0 of the cascade is a Bloom filter of the listed keys. Level 1 encodes
the keys of the corpus that pass level 0 without being listed, level 2 the
listed keys that pass level 1, and so on until no key passes wrongly. As the
levels cover every key that the corpus has, membership is exact for all of
them, and a lookup reads a few words of constant arrays: no join, no shuffle.

The key universe is reduced to distinct keys with map-side aggregation, so one
host with a third of all rows costs no more than another. Filters larger than
``max_words`` words are split by key into shards, each judged in a pass of its
own over the rows of that shard, so what a task holds stays bounded.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no
rule and is never listed. Empty tables give empty results. Repeated rows are
judged alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import literal_longs, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Fixed values: (verdict, host, path) in no order; the longest that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Host labels that put an address on the block list.
LISTED_LABEL = r"(^|[.])(spam|ads)-[^.]*([.]|$)"

BITS_PER_KEY, HASHES = 10, 4
Level = tuple[int, list[int]]


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(i)), 64 - bits) for i in range(HASHES)]


def _bloom(keys: DataFrame, level: int, n: int) -> Level:
    """Power of two and words of a filter over ``n`` keys. The words that reach the driver are the filter: bounded by its size."""
    bits = max(6, math.ceil(math.log2(n * BITS_PER_KEY)))
    at = F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at")
    mask = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = keys.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(mask).alias("m")).collect()
    words = [0] * (1 << (bits - 6))
    for r in rows:
        words[r["w"]] = r["m"]
    return bits, words


def _passes(key: Column, level: int, bloom: Level) -> Column:
    bits, words = bloom
    array = literal_longs(words)
    hit = [F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _positions(key, level, bits)]
    return reduce(lambda a, b: a & b, hit)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels of the cascade; both tables have one column ``key`` of distinct, non-null keys, and listed keys may lie outside the universe."""
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    while n := inside.count():
        levels.append(_bloom(inside, len(levels), n))
        inside, outside = stored(outside.filter(_passes(F.col("key"), len(levels) - 1, levels[-1])), "cascade"), inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether ``key`` is listed. The first level that refuses it decides: an even one says no, an odd one yes."""
    verdict = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        verdict = F.when(~_passes(key, k, levels[k]), F.lit(k % 2 == 1)).otherwise(verdict)
    return verdict


def with_membership(rows: DataFrame, key: str, listed: DataFrame, name: str = "listed", max_words: int = 1 << 20) -> DataFrame:
    """``rows`` with a boolean column ``name``: is the key in ``listed`` (one column ``key``)?"""
    listed = stored(listed.filter("key is not null").distinct(), "listed")
    universe = stored(rows.select(F.col(key).alias("key")).filter("key is not null").distinct(), "universe")
    shards = max(1, math.ceil(listed.count() * BITS_PER_KEY / 64 / max_words))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(shards))
    parts = []
    for s in range(shards):
        own = (lambda df, c: df) if shards == 1 else (lambda df, c, s=s: df.filter(shard(F.coalesce(F.col(c), F.lit(""))) == s))
        levels = build_cascade(own(listed, "key"), own(universe, "key"))
        parts.append(own(rows, key).withColumn(name, F.coalesce(member(F.col(key), levels), F.lit(False))))
    return reduce(DataFrame.unionAll, parts)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as its text and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def listed_addresses(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The block list: every address on a host with a listed label."""
    at = pages.select(host_of(url_col).alias("h"), path_of(url_col).alias("p"))
    return at.filter(F.col("h").rlike(LISTED_LABEL)).select(F.concat("h", "p").alias("key")).distinct()


def url_filter(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, verdict, listed. Where no rule fits, listed addresses are blocked and others allowed."""
    at = pages.select(F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    judged = with_membership(at.withColumn("_key", F.concat("host", "path")), "_key", listed)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def url_verdicts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return url_filter(pages, listed_addresses(pages))


ORACLE = r"""
with a as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), r as (
  select *, regexp_matches(host, '(^|[.])(spam|ads)-[^.]*([.]|$)') as listed,
    case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from a
)
select page_id, host, path, rule,
       case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
            when listed then 'block' else 'allow' end as verdict, listed
from r
"""
