import math
import zlib
from collections import Counter, defaultdict, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaver.llm import exchange
from quaver.llm import suffix_tree_lm as lm

SF = "/root/testdata/sf0.001"


def plain_scores(rows):
    """The model by dictionaries of words."""
    texts = []
    for d, t in rows:
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        texts.append((d, held, [w.decode() for w in (t or "").encode().lower().split()] + [None]))
    c = Counter()
    for _, held, w in texts:
        if not held:
            c.update(w)
    total, known = sum(c.values()), len(c)
    root = lambda s: ((c[s] - lm.DISCOUNT) if c[s] else lm.DISCOUNT * known) / total if known else 1.0
    states, nxt, size = {}, {}, {(): total}

    def smoothed(h, s, less):
        p = root(s)
        for k in range(1, len(h) + 1):
            g = h[len(h) - k :]
            if g in states or k == len(h):
                p = (max(nxt[g][s] - less, 0) + lm.PRIOR * p) / (size[g] - less + lm.PRIOR)
        return p

    def longest(h):
        return next((h[k:] for k in range(len(h)) if h[k:] in states), ())

    d, examined = 1, {(): None}
    while examined:
        found = defaultdict(Counter)
        for _, held, w in texts:
            if not held:
                for i in range(d, len(w)):
                    h = tuple(w[i - d : i])
                    if h[1:] in examined and h[:-1] in examined:
                        found[h][w[i]] += 1
        examined, passed = {}, []
        for h, successors in found.items():
            n = sum(successors.values())
            # A state of depth d - 1 is not known when contexts of d words are examined.
            known_state = len(longest(h[2:])) if d > 2 else 0
            if n < lm.MIN_COUNT or known_state < d - 1 - lm.LOOK:
                continue
            examined[h], nxt[h], size[h] = None, successors, n
            gain = sum(m * round((math.log(smoothed(h, s, 1) / smoothed(longest(h), s, 1)) - lm.MIN_GAIN) * lm.GAIN_SCALE) for s, m in successors.items())
            if gain >= 0:
                passed.append(h)
        states.update(dict.fromkeys(passed))
        d += 1
    out, deepest = {}, max(map(len, states), default=0)
    for row, (doc, held, w) in enumerate(texts):
        score = base = used = 0
        for i, s in enumerate(w):
            h = longest(tuple(w[max(0, i - deepest) : i]))
            score += math.log10(smoothed(h, s, 0))
            used += len(h) > 0
            base += math.log10((c[s] + 0.1) / (total + 0.1 * (known + 1)))
        out[row] = (doc, held, len(w), sum(c[s] > 0 for s in w), base, score, used)
    return out, total


@pytest.mark.parametrize("size", [8 << 20, 20000])
def test_matches_plain_model(spark, size):
    hard = [(None, None), (None, "a b c"), (7001, ""), (7002, "THE the The"), (7002, "THE the The"), (7003, "word " * 3000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(hard, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    want, total = plain_scores(rows)
    out = lm.score_texts(docs.withColumn("score", F.lit("clash")), block_bytes=size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[4], 6), round(r[5], 4), r[6])
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["n_states"]) for r in out if r["doc_id"] is not None)
    exp = sorted(w for w in want.values() if w[0] is not None)
    assert len(out) == len(rows) and {r["train_tokens"] for r in out} == {total}
    for g, e in zip(got, exp):
        assert key(g)[:4] == key(e)[:4] and g[1] == e[1] and g[6] == e[6]
        assert math.isclose(g[4], e[4], rel_tol=1e-9) and math.isclose(g[5], e[5], rel_tol=1e-6)
    assert sum(g[6] for g in got) > 0
    held = [g for g in got if g[1]]
    assert sum(g[5] for g in held) > sum(g[4] for g in held)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(docs).count() == 0


def test_nothing_to_train_on(spark):
    out = lm.score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert out["held_out"] and out["train_tokens"] == 0 and out["score"] == 0 and out["base_score"] == 0


def test_context_of_four_words(spark):
    """Only the fourth word back tells what comes: shorter contexts fail or leave it open."""
    texts = [(i, ("north east west south sun" if i % 2 else "below east west south rain")) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = lm.score_texts(docs).collect()
    assert {r["depth"] for r in out} == {4}
    assert min(r["score"] for r in out) > -1.2
    spread = lm.score_texts(docs.repartition(7), block_bytes=100).collect()
    key = lambda r: (r["doc_id"], r["n_states"], r["depth"], round(r["score"], 9))
    assert sorted(map(key, out)) == sorted(map(key, spread))


def test_contexts_of_a_small_corpus_stay_in_a_large_one(spark):
    rare = [(i, "rare pair") for i in range(20)]
    large = spark.range(100, 116).select(F.col("id").alias("doc_id"), F.expr("repeat('filler ', 1600000)").alias("text"))
    out = lm.score_texts(spark.createDataFrame(rare, "doc_id long, text string").union(large)).where("doc_id < 100").collect()
    trained = sum(not r["held_out"] for r in out)
    assert lm.MIN_COUNT <= trained <= 20 and out[0]["train_tokens"] > 20_000_000
    assert {r["n_states"] for r in out} == {2}


def test_what_one_block_has_is_not_sent_and_keys_are_short():
    words = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5, dtype=np.uint64))
    tokens = np.array([0, 1, 2, 3] * 30 + [4], np.uint32)
    row = namedtuple("Row", "block doc_ids lengths words tokens")("0-0", [7003], [len(tokens)], exchange.packed(words), exchange.packed(tokens))
    counts, other = np.array([30, 30, 30, 30, 1], np.int64), np.array([0, 0, 1, 0, 1], np.int64)
    ranks = lambda alone: exchange.packed(np.diff(np.arange((alone == 0).sum()), prepend=0).astype(np.uint32))
    for alone, keys in ((np.ones(5, np.int64), 0), (other, 2)):
        block, spaces = lm.Block(row), {0: 5, 1: 25}
        reply = lm.Reply([{"bucket": 0, "numbers": exchange.packed(counts << 1 | alone), "ranks": ranks(alone)}], 1, 5, 1)
        block.begin(reply, 121, 5)
        block.examine(spaces)
        # Of the pairs only 0 1 and 3 0 have no word that is in this block alone.
        assert len(block.sent) == keys and len(block.next_hash) == 5
        assert not (block.sent_keys & np.uint64((1 << 56) - 1)).any()
        assert len(block.messages(1, spaces)) == 1


def test_short_keys_are_distinct():
    keys = lm._spread(np.arange(1 << 16, dtype=np.uint64), 16)
    assert len(np.unique(keys)) == 1 << 16 and not (keys & np.uint64((1 << 48) - 1)).any()
