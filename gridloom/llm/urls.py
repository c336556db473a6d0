"""URL verdicts: longest host-and-path rule, else a list of canonical URLs behind a blocked Bloom filter.

Method: the listed URLs set eight bits each (one in each 64-bit word) of a 512-bit block chosen by their hash. The
filter is a table of at most ``2**max_block_bits`` blocks, so what is broadcast is bounded (4 MB) however long the
list is; a longer list only lets more URLs through. What passes is joined exactly with the list, which removes
the false positives. URLs that the filter rejects get a join key of their own, so they spread evenly.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the verdict allow; a
null page_id stays null; repeated rows are each judged; other columns are ignored.
"""

from __future__ import annotations

import json
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Of the query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without its last slash, and the sorted query without tracking parameters."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. Rules are configuration: one literal list, longest first, tried in turn."""
    order = sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)
    listed = [{"action": a, "text": t, "host": t.split("/", 1)[0], "path": "/" + t.split("/", 1)[1]} for a, t in order]
    of = F.from_json(F.lit(json.dumps(listed)), "array<struct<action:string,text:string,host:string,path:string>>")
    fits = F.filter(of, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    first = F.get(fits, F.lit(0))
    return first["text"], first["action"]


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)]


def bloom_filter(listed: DataFrame, key: str, max_block_bits: int = 16) -> tuple[DataFrame, int]:
    """Rows (block, w0 .. w7), and the number of blocks: about 16 bits a key, up to the bound."""
    n = listed.count()
    blocks = 1 << min(max_block_bits, max(4, ceil(log2(max(1, n / 32)))))
    block, bits = _bits(F.col(key), blocks)
    return listed.groupBy(block).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bits)]), blocks


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], max_block_bits: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages (page_id, url); listed has a column url."""
    names = listed.select(canonical(F.col("url")).alias("name")).distinct()
    bloom, blocks = bloom_filter(names, "name", max_block_bits)
    url = F.col("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"), F.monotonically_increasing_id().alias("row"))
    parts = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    block, bits = _bits(F.col("canon"), blocks)
    probed = parts.withColumn("block", block).join(F.broadcast(bloom), "block", "left")
    hit = F.col("rule").isNull() & (F.col("host") != "")
    for i, b in enumerate(bits):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(b) != 0)
    keyed = probed.withColumn("name", F.when(hit, F.col("canon")).otherwise(F.concat(F.lit("\x00"), F.col("row"))))
    found = keyed.join(names.withColumn("listed", F.lit(True)), "name", "left")
    is_listed = F.coalesce("listed", F.lit(False))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the query: of the canonical URLs of hosts named spam-farm those whose MD5 begins with 0 to 7, so that
    listed and unlisted pages of one host are told apart by the filter and the join, not by the host."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    farm = pages.filter(host_of(url).rlike(r"(^|\.)spam-farm\.") & F.md5(canonical(url)).rlike("^[0-7]"))
    return judge_urls(pages, farm, RULES).drop("listed")


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_OP9 = rf"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q
  FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canon FROM p
), l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)spam-farm\.') AND regexp_matches(md5(canon), '^[0-7]')),
r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (
  SELECT c.*, r.action, r.rhost || r.rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM c LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN canon IN (SELECT canon FROM l) AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict FROM j WHERE k = 1
"""
