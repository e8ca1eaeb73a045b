"""URL rules behind a blocked Bloom filter (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ascii_lower

# A block is 8 words of 64 bits; a key sets one bit in each word.
WORDS = 8


def url_host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; '' without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ? or # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """Bit of ``word`` for a key: 6 bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of column ``key``: block and its words w0..w7."""
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key"), j)) for j in range(WORDS)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(
        *[F.bit_or(bit).alias(f"w{j}") for j, bit in enumerate(one)]
    )


def bloom_hit(key: Column) -> Column:
    """True where every bit of ``key`` is set in the joined block."""
    hit = F.lit(True)
    for j in range(WORDS):
        hit = hit & (F.call_function("getbit", F.col(f"w{j}"), _bit(key, j)) == 1)
    return hit


RESULT = ("url_host", "url_path", "url_rule", "url_verdict")


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, default: str = "allow", bits_per_key: int = 16, url: str = "url"
) -> DataFrame:
    """Every row of ``pages`` with url_host, url_path, url_rule, url_verdict in place of other columns.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains when the url's
    path starts with the rule's; the longest rule wins (then the one with the longer host). Urls
    that no rule fits get ``default``.

    Each distinct host and path offers its host suffixes with those path prefixes whose length
    occurs among the rules as keys. Keys pass the blocked Bloom filter of the rules (joined by
    block number) and then an exact join with the rules, which removes false positives. The
    filter has ``bits_per_key`` bits per rule, so lists of any length keep the same error; all
    joins are plain equi-joins whose strategy the optimizer picks by size. The driver receives
    the number of rules and the distinct lengths of their paths (at most the longest path).

    Null urls and urls without :// have host and path '' and no rule. Rules with a null host or
    path are ignored, repeated rules count once (a block wins over an allow). Repeated pages stay
    repeated. Empty tables give empty results; without rules every url gets the default.
    """
    spark = pages.sparkSession
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .withColumn("key", F.concat("rule_host", "rule_path"))
        .groupBy("key", "rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    size = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("rule_path"))).first()
    blocks = max(1, -(-size[0] * bits_per_key // (64 * WORDS)))
    lengths = sorted(size[1]) or [0]
    # Other columns travel in one struct, so that none of their names can meet one used here.
    kept = [c for c in pages.columns if c not in RESULT]
    page = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    rows = pages.select(page.alias("page"), url_host(F.col(url)).alias("url_host"), url_path(F.col(url)).alias("url_path"))
    labels = F.split("url_host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    known = F.array(*[F.lit(n) for n in lengths])
    prefixes = F.transform(
        F.filter(known, lambda n: n <= F.length("url_path")), lambda n: F.substring(F.col("url_path"), F.lit(1), n)
    )
    urls = rows.select("url_host", "url_path").where("url_host <> ''").distinct()
    keys = (
        urls.withColumn("key_host", F.explode(hosts))
        .withColumn("key_path", F.explode(prefixes))
        .withColumn("key", F.concat("key_host", "key_path"))
        .withColumn("block", _block(F.col("key"), blocks))
    )
    possible = keys.join(bloom_blocks(rules.select("key"), blocks), "block").where(bloom_hit(F.col("key")))
    listed = rules.withColumnsRenamed({"key": "url_rule", "rule_path": "key_path"}).withColumn("key_host", F.col("rule_host"))
    exact = possible.join(listed, ["key_host", "key_path"]).select(
        "url_host", "url_path", "url_rule", "rule_verdict", "rule_host"
    )
    won = exact.groupBy("url_host", "url_path").agg(
        F.max_by(
            F.struct("url_rule", "rule_verdict"),
            F.struct(F.length("url_rule"), F.length("rule_host"), "rule_verdict"),
        ).alias("won")
    )
    return rows.join(won, ["url_host", "url_path"], "left").select(
        *([F.col("page.*")] if kept else []),
        "url_host",
        "url_path",
        F.col("won.url_rule").alias("url_rule"),
        F.coalesce("won.rule_verdict", F.lit(default)).alias("url_verdict"),
    )
