"""URL filtering by a Bloom filter cascade, with built-in expressions only.

A blocklist names hosts; a listed host stands for its subdomains too. The
cascade's first level encodes the listed keys, the second the false positives of
the first over the corpus's complete key universe, the third the listed keys
that pass the second, and so on until a level has no false positives. A key's
first refusing level then tells, with no error, whether it is listed: a probe is
a few bit tests on fixed arrays, and no URL is ever joined with the list.

The universe (every distinct host suffix of the corpus that the list could name, and
the list) is labelled by one grouped union. Each level is one grouped ``bit_or``,
read by the driver into an array of bounded size that the plan carries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

#: Production list: each family of hosts under each ending, by itself and numbered
#: below NUMBERED; a listed host stands for all below it too.
FAMILIES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("example.com", "example.net", "example.org")
NUMBERED = 400
#: Fixed rules: host, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

BITS_PER_KEY, HASHES = 10, 4
#: 64-bit words of one level's array (8 MB); a longer list is dealt to shards by the
#: hash of its keys, each with its own cascade, that are run one after the other.
MAX_WORDS = 1 << 20


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = _base.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*+", 0))
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def suffixes(host: Column, most: int) -> Column:
    """The last 1, 2, ... most labels of a host: all that a list whose longest
    entry has so many labels can name."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


@dataclass
class Level:
    bits: int
    words: list[int]


def positions(key: Column, level: int, bits: int) -> list[Column]:
    """Double hashing with a seed of the level."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.shiftrightunsigned(a, 2) + F.lit(i) * F.shiftrightunsigned(b, 8), F.lit(bits)) for i in range(HASHES)]


def build_level(keys: DataFrame, level: int, n: int) -> Level:
    words = max(1, math.ceil(n * BITS_PER_KEY / 64))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, words * 64))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).collect()
    out = [0] * words
    for r in rows:
        out[r.w] = r.v
    return Level(words * 64, out)


def passes(key: Column, level: int, it: Level) -> Column:
    array = F.array(*[F.lit(x) for x in it.words]) if len(it.words) < 256 else F.from_json(F.lit(str(it.words)), "array<bigint>")
    tests = [F.get(array, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))) != 0 for p in positions(key, level, it.bits)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def build(universe: DataFrame) -> list[Level]:
    """universe: distinct ``key`` and ``listed``: the list, and every key of the corpus."""
    levels: list[Level] = []
    mine, other = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    n = mine.count()
    while n:
        level = len(levels)
        levels.append(build_level(mine, level, n))
        mine, other = other.filter(passes(F.col("key"), level, levels[-1])), mine
        n = mine.count()
    return levels


def blocklist(spark: SparkSession) -> DataFrame:
    """The production list, made from its rule."""
    names = spark.range(0, NUMBERED + 1).select(F.when(F.col("id") > 0, F.concat(F.lit("-"), F.col("id"))).otherwise("").alias("n"))
    names = names.select(F.explode(F.array(*[F.concat(F.lit(f), F.col("n"), F.lit("." + e)) for f in FAMILIES for e in ENDINGS])).alias("host"))
    return names


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))


def listed(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe: the first refusing level decides; a key
    that no level refuses has the side of the last."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, blocklist: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to the columns of pages
    (replacing any of these names). blocklist: one string column of hosts.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end; both are empty
    for a null url and one without ``://``. A rule fits its host and all below
    it when the path starts with the rule's; the longest wins. Without a rule
    the verdict is block when the host or a parent is listed, else allow. Null
    and repeated list entries are ignored; an empty host is never listed. Rows
    are independent; repeated and empty tables are fine.
    """
    spark = pages.sparkSession
    name = blocklist.columns[0]
    wanted = blocklist.select(_base.ascii_lower(F.col(name)).alias("key")).filter("key is not null and key <> ''").distinct()
    most = wanted.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    keys = pages.select(host_of(F.col(url)).alias("h")).filter("h <> ''").distinct().select(F.explode(F.array_distinct(suffixes(F.col("h"), most))).alias("key"))
    both = wanted.select("key", F.lit(True).alias("listed"), F.lit(False).alias("met")).unionByName(keys.select("key", F.lit(False).alias("listed"), F.lit(True).alias("met")))
    scratch = _base.Scratch(spark)
    universe = scratch.keep(both.groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    shards = max(1, math.ceil(universe.filter("listed").count() * BITS_PER_KEY / 64 / MAX_WORDS))
    flag, refused = _base.unused(pages, "listed_"), F.lit(False)
    for i in range(shards):
        own = shard_of(F.col("key"), shards) == i
        levels = build(universe.filter(own))
        refused = F.exists(suffixes(host_of(F.col(url)), most), lambda k: (shard_of(k, shards) == i) & listed(k, levels))  # noqa: B023
        if shards > 1:  # one shard's arrays in a plan at a time
            pages = scratch.keep(pages.withColumn(flag, F.col(flag) | refused if i else refused), f"shard{i}")
            scratch.drop(f"shard{i - 1}")
            refused = F.col(flag)
    scratch.drop("universe")

    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(F.concat(F.lit("."), host).endswith("." + h) & path.startswith(p), h + p, v) for h, p, v in ordered]
    rule, verdict = F.lit(None).cast("string"), F.when((host != "") & refused, "block").otherwise("allow")
    for fit, text, v in reversed(fits):
        rule, verdict = F.when(fit, text).otherwise(rule), F.when(fit, v).otherwise(verdict)
    return out.withColumns({"rule": rule, "verdict": verdict}).drop(flag)
