"""URL filters: longest fitting rule, else a list of blocked URLs behind a blocked Bloom filter; no Python in the plan.

The filter is a table with one row a block: 8 words of 32 bits, one bit set in each by every listed
URL that hashes to the block (16 bits a URL). A URL whose 8 bits are all set is a possible hit; only
possible hits go to the exact hash join with the list, which removes the false positives. Both sides
are broadcast only if they are counted small, else joined by shuffle.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is not
listed (verdict allow); every row is kept, equal or null ids too; null URLs in the list are skipped,
repeated ones count once; an empty list blocks nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import small_or_shuffled, written

BITS_A_URL = 16
WORDS = 8
#: Up to so many rules stand in the plan as a literal; more are joined by host. Results are the same.
LITERAL_RULES = 200
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and a default port, path without a closing ``/``, ``.html`` or ``index``; no scheme, query or fragment; null without a host."""
    plain = F.concat(F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), r":(80|443)\z", ""), F.regexp_replace(F.regexp_replace(path, r"[.]html?\z", ""), r"(/index)?/*\z", ""))
    return F.when(host != "", plain)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct(size, rule, verdict)`` of the longest rule (verdict, host, path) that fits, or null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def with_longest_rule(rows: DataFrame, rules: Sequence[tuple[str, str, str]], literal: int = LITERAL_RULES) -> DataFrame:
    """``rows`` (with ``host, path``) and ``__rule`` as by ``longest_rule``; many rules meet each distinct URL at its host and at every domain above it."""
    if len(rules) <= literal:
        return rows.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules))
    listed = rows.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "__domain string, __start string, verdict string")
    listed = listed.select("__domain", "__start", F.length(F.concat("__domain", "__start")).alias("size"), F.concat("__domain", "__start").alias("rule"), "verdict")
    labels = F.split("host", "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.select("host", "path").distinct().withColumn("__domain", F.explode(domains)).join(small_or_shuffled(listed), "__domain")
    best = met.where(F.col("path").startswith(F.col("__start"))).groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("__rule"))
    return rows.join(small_or_shuffled(written(best, "url-rules")), ["host", "path"], "left")


def _bits(url: Column, blocks: int) -> list[Column]:
    second = F.xxhash64(url, F.lit(17))
    bit = lambda i: F.pmod(F.shiftrightunsigned(second, 5 * i), F.lit(32))
    words = [F.call_function("shiftleft", F.lit(1), bit(i).cast("int")).alias(f"__w{i}") for i in range(WORDS)]
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("__block"), *words]


def bloom_blocks(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """The filter of the URLs in ``url_col``: ``__block`` and ``__f0`` to ``__f7``, blocks without a URL left out."""
    return listed.select(*_bits(F.col(url_col), blocks)).groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__f{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, listed`` of every row; ``listed``: the URL's canonical form is in the list."""
    keys = written(listed.select(canonical(host_of(F.col(listed_col)), path_of(F.col(listed_col))).alias("__listed")).where("__listed IS NOT NULL").distinct(), "urls")
    blocks = max(1, -(-keys.count() * BITS_A_URL // (32 * WORDS)))
    bloom = bloom_blocks(keys, "__listed", blocks)

    rows = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("__canonical", canonical(F.col("host"), F.col("path")))
    rows = with_longest_rule(rows, rules)
    held = rows.select("*", *_bits(F.col("__canonical"), blocks)).join(small_or_shuffled(bloom), "__block", "left")
    all_set = " AND ".join(f"coalesce(__w{i} & __f{i}, 0) <> 0" for i in range(WORDS))
    # One scan: what passes the filter joins under its URL, the rest under keys that no URL has, spread by their hash.
    key = F.when(F.expr(f"__canonical IS NOT NULL AND {all_set}"), F.col("__canonical")).otherwise(F.concat(F.lit("\n"), F.xxhash64("__id", "path").cast("string")))
    sure = small_or_shuffled(keys.select(F.col("__listed").alias("__key"), F.lit(True).alias("__in")))
    out = held.withColumn("__key", key).join(sure, "__key", "left").withColumn("listed", F.coalesce("__in", F.lit(False)))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
