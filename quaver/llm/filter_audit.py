"""Filter interaction audit: what each filter removes in every order, by a subset-zeta transform.

``failures`` gives each text the bits of the filters that it fails, ``mask_counts``
counts distinct bit patterns by part and label, ``survivors`` turns a part's counts
into the rows that stay for every subset of filters at once, and ``order_steps``
reads each step of each order off neighbouring subsets. Texts are read once; from
``mask_counts`` on there are at most 2^k rows a part, whatever the corpus holds.

Equal texts are found by their SHA-256. Each task sums the copies that it has
before they are sent, so a text with very many copies is a few rows a task.

Defined results: a null text is empty, a null language is the part ``''``. Rows that
repeat an id are rows of their own, and the copies under the least id of a text all
pass filter E. A row without id is nobody's earlier copy and fails E never. Labels
are joined by id; of several labels of an id a 1 of any counts, and a row without
labels is neither good nor toxic. An empty table gives no rows. Other columns of
either table are not read.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import read, words

#: Filters decided by the text alone: letter and failing condition over the measurements.
TEXT_FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "has_symbol",
}
#: Removes copies of a text under any smaller id.
COPIES = "E"
LETTERS = "".join(TEXT_FILTERS) + COPIES


def failures(docs: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id, part, digest, mask`` of each row; the mask has the filters of ``TEXT_FILTERS`` alone."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("_text"))
    rows = rows.select("*", words(F.col("_text")).alias("_words"))
    rows = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("_text", 256)).alias("digest"),
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length("_text").cast("long").alias("n_chars"),
        F.col("_text").rlike("[#$%&*|]").alias("has_symbol"),
    )
    bits = [F.when(F.expr(fails), 1 << i).otherwise(0) for i, fails in enumerate(TEXT_FILTERS.values())]
    return rows.select("doc_id", "part", "digest", sum(bits[1:], bits[0]).cast("int").alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, copies_bit: int = 1 << len(TEXT_FILTERS)) -> DataFrame:
    """``part, mask, n, good, toxic``: rows by the filters they fail, copies included, and how many of them are labelled."""
    flag = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = failed.join(known, "doc_id", "left").na.fill(0, ["quality", "toxic"])
    by = ["digest", "part", "mask", "quality", "toxic"]
    # Equal ids first, so that the least id's rows are counted; then copies, pre-summed by task.
    rows = rows.groupBy("doc_id", *by).agg(F.count("*").alias("n"))
    rows = rows.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
    )
    # A text has a row for each part and label, however many copies it has.
    first = F.min("least").over(Window.partitionBy("digest"))
    rows = rows.withColumn("_first", first)
    passes = F.col("nameless") + F.when(F.col("least") == F.col("_first"), F.col("n_least")).otherwise(0)
    sides = F.array(F.struct("mask", passes.alias("n")), F.struct((F.col("mask") + F.lit(copies_bit)).alias("mask"), (F.col("n") - passes).alias("n")))
    rows = rows.select("part", "quality", "toxic", F.inline(sides)).where("n > 0")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _zeta(counts: str, k: int) -> Column:
    """Sums over all subsets of each mask, a bit at a time."""
    step = "transform(a, (x, i) -> x + if((i & shiftleft(1, b)) != 0, a[cast(i - shiftleft(1, b) as int)], 0L))"
    return F.expr(f"aggregate(sequence(0, {k - 1}), {counts}, (a, b) -> {step})")


def survivors(counts: DataFrame, k: int, measures: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """One row a part: for each measure an array, at place S the rows that fail no filter of subset S."""
    full = (1 << k) - 1
    table = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("_by"))
    at = lambda m: F.expr(f"transform(sequence(0, {full}), i -> coalesce(try_element_at(_by, i).{m}, 0L))").alias(m)
    table = table.select("part", *[at(m) for m in measures])
    # Who fails nothing of S fails a subset of what S leaves out.
    return table.select("part", *[_zeta(m, k).alias(m) for m in measures]).select("part", *[F.reverse(m).alias(m) for m in measures])


def order_steps(alive: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step: differences between neighbouring subsets."""
    k = len(letters)
    full = (1 << k) - 1
    steps, bit = [], {c: 1 << i for i, c in enumerate(letters)}
    for order in permutations(letters):
        for i, c in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": i + 1, "before": sum(bit[x] for x in order[:i]), "bit": bit[c]})
    weights = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) if s.bit_count() < k else 0 for s in range(full + 1)]
    gain = "if((s & shiftleft(1, b)) = 0, w * (n[s] - n[s | shiftleft(1, b)]), 0L)"
    shares = f"transform(sequence(0, {k - 1}), b -> aggregate(transform(_w, (w, s) -> {gain}), 0L, (t, x) -> t + x))"
    rows = alive.withColumn("_w", F.lit(weights).cast("array<bigint>")).withColumn("_shares", F.expr(shares)).drop("_w")
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    rows = rows.select("*", F.inline(plan)).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = lambda m: F.expr(f"{m}[before] - {m}[after]")
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.expr("n[after]").alias("kept"),
        lost("n").alias("removed"),
        (F.expr("n[0] - n[bit]") - lost("n")).alias("redundant"),
        F.expr(f"n[{full} - bit] - n[{full}]").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.expr("_shares[cast(log2(bit) as int)]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    return order_steps(survivors(mask_counts(failures(docs, text, part), labels), len(LETTERS)))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
f AS (
  SELECT part, doc_id, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > first_id, false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS v),
p AS (
  SELECT [a.v, b.v, c.v, d.v, e.v] AS o FROM x a, x b, x c, x d, x e
  WHERE b.v <> a.v AND c.v NOT IN (a.v, b.v) AND d.v NOT IN (a.v, b.v, c.v) AND e.v NOT IN (a.v, b.v, c.v, d.v)),
s AS (
  SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, v + 1 AS step, 1 << o[v + 1] AS bit,
    coalesce(list_sum(list_transform(o[:v], lambda i: 1 << i)), 0)::INT AS before FROM p, x),
r AS (
  SELECT part, filter_order, step::INT AS step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
