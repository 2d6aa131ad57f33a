"""Rule bitmask ledger: every rule once, then any number of policies on the bits.

``measure`` takes the measurements of each text, ``ledger`` evaluates every rule
on them once and keeps one bit a rule, ``apply_policy`` reads a version's verdict
off the bits and ``ablation`` says what each rule adds to a policy from counts
of distinct bit patterns, without another look at the texts. All of it is
DataFrame expressions.

Defined results: a null or empty text has no words, so all measurements are 0
and the rule on few words fails. Rows with equal or null ids stay separate rows.
An empty table gives an empty ledger. Other columns of the input are not read,
and pass through ``ledger`` unless they share a measurement's name, which the
ledger's own column then replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import WHITE, words

SYMBOLS = "#*$%&|<>"

#: Bit, name and failing condition over the measurements, in SQL both engines read.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 5 * word_chars"),
    (3, "shouting", "100 * n_upper > 40 * n_letters"),
    (4, "exclaiming", "100 * n_exclaim > 30 * n_words"),
    (5, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    (6, "long_words", "word_chars > 20 * n_words"),
)

#: Rules that each version of the policy applies.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "exclaiming"),
    "strict": tuple(name for _, name, _ in RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclaim")


def mask(policy: str, without: str | None = None) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy] if name != without)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each text.

    ``n_repeat_words`` counts the words in three-word windows found twice or
    more in the text. Windows are compared by a 64-bit hash: texts without an
    equal pair leave at once, the others sort (hash, position) within the row.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(*kept, body.alias("_text")).select(
        "*",
        words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("_lines"),
    )
    step = step.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _count_of(F.col("_text"), upper).cast("long").alias("n_upper"),
        _count_of(F.col("_text"), upper + upper.lower()).cast("long").alias("n_letters"),
        _count_of(F.col("_text"), "!").cast("long").alias("n_exclaim"),
        F.when(
            F.size("_words") > 3,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - 2),
                lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)),
            ),
        ).alias("_windows"),
    )
    measured = [c for c in step.columns if c != "_windows"]
    step = step.select(
        *measured,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).alias("_sorted"),
    )
    repeated = F.filter(
        "_sorted",
        lambda x, i: (F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"])),
    )
    step = step.select(*measured, F.array_sort(F.transform(repeated, lambda x: x["p"])).alias("_starts"))
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.coalesce(F.least(F.lit(3), F.get("_starts", i + 1) - p), F.lit(3))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return step.select(*measured, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed_bits``: bit b is set where rule b fails.

    Write the ledger before filtering on it: Spark moves a filter below the
    projections it reads from, and would evaluate their nested arrays anew for
    every use.
    """
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << bit} ELSE 0 END" for bit, _, condition in RULES)
    return measure(docs, text).withColumn("failed_bits", F.expr(f"CAST({bits} AS BIGINT)"))


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Add ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects."""
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(1 << bit).cast("long").alias("own"),
            F.lit(mask(policy, name)).cast("long").alias("others"),
        )
        for bit, name, _ in RULES
        if name in POLICIES[policy]
    ]
    each = patterns.select("failed_bits", "n", F.explode(F.array(*rules)).alias("r")).select("failed_bits", "n", "r.*")
    fails = F.col("failed_bits").bitwiseAND(F.col("own")) != 0
    alone = fails & (F.col("failed_bits").bitwiseAND(F.col("others")) == 0)
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"),
    )


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = apply_policy(ledger(docs))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed_bits",
    )


_RULE_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << b} ELSE 0 END" for b, _, c in RULES)
OP5_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT row_no, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
h AS (SELECT row_no, p, count(*) OVER (PARTITION BY row_no, words[p], words[p + 1], words[p + 2]) AS n FROM g),
r AS (SELECT row_no, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT row_no, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY row_no),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
        length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaim,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (row_no)),
b AS (SELECT *, ({_RULE_BITS})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {mask("base")}) <> 0 AS base_failed, (failed_bits & {mask("v2")}) = 0 AS kept, failed_bits
FROM b
"""
