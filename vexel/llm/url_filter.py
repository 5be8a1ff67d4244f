"""URL filters: longest matching rule, else exact blocklist membership from a cascade of Bloom filters.

Only DataFrame functions run on the main path. The cascade is built over the corpus's complete key universe
(every distinct host): level 1 holds the hosts at or under a listed domain, level 2 the other hosts that level 1
accepts by mistake, level 3 the listed hosts that level 2 accepts, and so on until a level makes no mistake. A host
is listed if the first level that rejects it has an even number, so no url is joined with the list.

Level 1 gets so many bits a key that it lets about as many other hosts pass as there are listed ones; so the cascade grows
with the list and the logarithm of the universe, not with the universe. Where it would pass `max_bits`, hosts are dealt by a
hash into shards with a cascade of their own, and the urls of one shard after another are judged by its cascade; so no task
or driver holds more than one cascade of about `max_bits`.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed. Repeated
rows are judged alike. Empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from vexel.llm.common import ascii_lower, cut, stored

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Registered names on the default blocklist, under each of the three endings.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [f"{name}.example.{end}" for name in LISTED_NAMES for end in ("com", "net", "org")]
#: Bits of a level sent to the tasks at once (16 MB); a longer list is dealt into shards.
MAX_BITS = 1 << 27
#: Bits a key of the levels after the first, and of the first at least: 2 % of the others pass.
BITS_PER_KEY = 8


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds __host and __path."""
    df = df.withColumn("__url", F.col(url))
    rest = F.when(F.locate("://", F.col("__url")) > 0, F.expr("substring(__url, locate('://', __url) + 3)"))
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    return df.withColumn("__host", ascii_lower(F.regexp_extract("__rest", r"^[^/?#]*", 0))).withColumn(
        "__path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)
    )


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        hit = fits(host, path, h, p)
        name, verdict = F.when(hit, F.lit(h + p)).otherwise(name), F.when(hit, F.lit(kind)).otherwise(verdict)
    return name, verdict


def domains(host: Column, most: int) -> Column:
    """A host and its parent domains of up to `most` labels: a.b.c, b.c, c. An empty host has none."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - most + 1)
    return F.when(host != "", F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(
        F.array().cast("array<string>")
    )


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: DataFrame  # one row, one array of 64-bit words

    def positions(self, key: Column) -> list[Column]:
        first, step = F.xxhash64(F.lit(self.seed), key), F.xxhash64(key, F.lit(self.seed))
        return [F.pmod(F.shiftrightunsigned(first, 2) + i * F.shiftrightunsigned(step, 8), F.lit(self.bits)) for i in range(self.hashes)]

    def accepts(self, key: Column, words: Column | None = None) -> Column:
        words = self.words.scalar() if words is None else words
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.getbit(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1)
        return out


def level_of(keys: DataFrame, n: int, seed: int, bits_per_key: int) -> Level:
    bits = max(64, math.ceil(n * bits_per_key / 64) * 64)
    lv = Level(bits, max(1, round(bits_per_key * math.log(2))), seed, keys)
    set_bits = keys.select(F.explode(F.array(*lv.positions(F.col("key")))).alias("p")).select(
        F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")
    )
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = set_bits.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    lv.words = cut(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")))
    return lv


def listed_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """The hosts (column `key`) that are a listed domain or under one."""
    most = listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
    named = hosts.select(F.col("key").alias("host"), F.explode(domains(F.col("key"), most)).alias("key"))
    return named.join(listed.select("key"), "key", "left_semi").select(F.col("host").alias("key")).distinct()


def first_bits(listed: int, others: int, least: int = BITS_PER_KEY) -> int:
    """Bits a key of level 1, at which about `listed` of the others pass."""
    return max(least, math.ceil(math.log2(max(1.0, others / max(1, listed))) / math.log(2)))


def build_cascade(universe: DataFrame, held: DataFrame, bits_per_key: int = BITS_PER_KEY) -> list[Level]:
    """Levels that tell `held` from the rest of `universe` (both distinct, column `key`); [] if nothing is held."""
    both = universe.select("key", F.lit(0).alias("on")).unionByName(held.select("key", F.lit(1).alias("on")))
    keys = cut(both.groupBy("key").agg(F.max("on").alias("on")))
    inside, outside, levels = keys.where("on = 1").select("key"), keys.where("on = 0").select("key"), []
    while n := inside.count():
        bits = bits_per_key if levels else first_bits(n, outside.count(), bits_per_key)
        levels.append(level_of(inside, n, len(levels) + 1, bits))
        inside, outside = cut(outside.where(levels[-1].accepts(F.col("key")))), inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether key, one of the universe, is held."""
    out = F.lit(False)
    for lv in reversed(levels):
        out = lv.accepts(key) & ~out
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; `listed` has the blocked domains in column `key`."""
    df = with_parts(pages.select(F.col(id_col).alias("__id"), F.col("url").alias("__u")), "__u")
    hosts = cut(df.select(F.col("__host").alias("key")).where("key <> ''").distinct())
    held = cut(listed_hosts(hosts, listed))
    n, universe = held.count(), hosts.count()
    shards = max(1, math.ceil(n * first_bits(n, universe - n) / max_bits))
    rule, verdict = rule_columns(F.col("__host"), F.col("__path"), rules)

    def judged(urls: DataFrame, levels: list[Level]) -> DataFrame:
        inside = (F.col("__host") != "") & member(F.col("__host"), levels)
        return urls.select(
            F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"),
            F.coalesce(verdict, F.when(inside, "block").otherwise("allow")).alias("verdict"),
        )

    if shards == 1:
        return judged(df, build_cascade(hosts, held))

    def of(rows: DataFrame, host: str, i: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(F.lit("shard"), host), F.lit(shards)) == i)

    urls = stored(df.select("__id", "__host", "__path"))
    parts = [stored(judged(of(urls, "__host", i), build_cascade(of(hosts, "key", i), of(held, "key", i)))) for i in range(shards)]
    return reduce(DataFrame.unionByName, parts)


def default_list(spark) -> DataFrame:
    return spark.createDataFrame([(k,) for k in LISTED], "key string")
