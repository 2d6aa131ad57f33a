"""URL verdicts: rules on hosts and paths, then a blocked Bloom filter and an exact join.

The Bloom filter of the listed canonical URLs is a table of blocks: a hash of
the URL picks the block, and one bit in each of its eight 64-bit lanes. Pages
that may be listed, as their block says, go on to an exact hash join with the
list, which removes the false positives; the others never reach the join. The
blocks are broadcast while their size, known before the join, is within
``broadcast_bytes``, and joined by block number beyond it.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is never listed. Nulls, blanks and repeats in the list count
once or not at all. Other columns of the pages are dropped by ``judge``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import ascii_lower, stored

BITS_A_URL = 12
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
TRACKING = r"^(utm_[^=]*|ref)="

#: Rule, verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a last slash or ``.html``, other parameters sorted.

    Null where the url has no host.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), QUERY, 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    bare = F.regexp_replace(host(url), r"^www\.", "")
    short = F.regexp_replace(path(url), r"(/|\.html)$", "")
    return F.when(host(url) != "", F.concat(bare, short, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _block(url_hash: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(url_hash, 3), F.lit(blocks))


def _lane_bit(url_hash: Column, lane: int) -> Column:
    """One of the lane's 64 bits, as a mask."""
    spread = F.xxhash64(url_hash, F.lit(lane))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 58).cast("int"))


def bloom_blocks(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """Blocks of the filter over ``listed`` (column ``canonical``), and how many there can be."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n_listed * BITS_A_URL / 512))))
    hashed = listed.select(F.xxhash64("canonical").alias("h"))
    lanes = [F.bit_or(_lane_bit(F.col("h"), i)).alias(f"lane{i}") for i in range(8)]
    return hashed.groupBy(_block(F.col("h"), blocks).alias("block")).agg(*lanes), blocks


def listed_pages(pages: DataFrame, listed: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``pages`` (with ``canonical``) whose URL is on the list, exactly."""
    listed = stored(listed.select("canonical").where("canonical is not null").distinct(), "url-list")
    n = listed.count()
    blocks, count = bloom_blocks(listed, n)
    blocks = stored(blocks, "url-bloom")
    if count * 72 <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    probe = pages.where("canonical is not null").withColumn("_h", F.xxhash64("canonical"))
    probe = probe.withColumn("block", _block(F.col("_h"), count))
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(_lane_bit(F.col("_h"), i)) != 0)
    possible = probe.join(blocks, "block").where(hit).select(pages.columns)
    return possible.join(listed.hint("shuffle_hash"), "canonical", "left_semi").select(pages.columns)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """A verdict for each row of ``pages`` (``page_id``, ``url``).

    A rule's verdict stands. Elsewhere a listed URL is blocked and others are
    allowed; only rows without a rule are looked up.
    """
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "canonical")
    # One row id a page: repeated and null ids must not meet each other's verdicts.
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    hits = listed_pages(rows.where("rule is null").select("_row", "canonical"), listed, broadcast_bytes)
    out = rows.join(hits.select("_row", F.lit("block").alias("_listed")), "_row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "_listed", F.lit("allow")).alias("verdict"))


def respelled(pages: DataFrame) -> DataFrame:
    """Canonical URLs that the pages spell in more than one way."""
    rows = pages.where("url is not null").select("url", canonical(F.col("url")).alias("canonical")).where("canonical is not null")
    return rows.groupBy("canonical").agg(F.min("url").alias("a"), F.max("url").alias("b")).where("a <> b").select("canonical")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list: canonical URLs that the table spells in more than one way."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, respelled(pages))


def _sql_rule(value: int) -> str:
    out = []
    for rule in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule[0].partition("/")
        out.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{rule[value]}'")
    return "CASE " + " ".join(out) + " END"


OP3_SQL = rf"""
WITH u AS (SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '{QUERY}', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS kept FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '')
    || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM u),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING min(url) <> max(url))
SELECT page_id, host, path, {_sql_rule(0)} AS rule,
    coalesce({_sql_rule(1)}, CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""
