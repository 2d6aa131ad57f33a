import math
import random
import re
from collections import Counter

import numpy as np
from quaver.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    by_item = {}
    for item_id, text in set(items):
        by_item.setdefault(item_id, Counter()).update(terms(text))
    out = []
    for item_id, wanted in by_item.items():
        scores = []
        for d, b in bags:
            tf, m = Counter(b), 100 - 25 + 25 * len(b) * n // max(total, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in wanted.items())
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item_id, i, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def fixture(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200])))) for i in range(n)]
    copies = "Rare passage of W5 words; w77 über straße 42!"
    docs += [(n + i, copies) for i in range(60)]
    docs += [(7, copies), (7, copies), (None, copies), (n + 70, None), (n + 71, ""), (n + 72, "--- \n"), (n + 73, "w5 " * 30_000)]
    items = [(1, "rare PASSAGE of w5, w5"), (2, "w1 w2 w3"), (3, None), (4, ""), (5, "nowhere"), (6, "ÜBER über Straße"), (6, "w9"), (6, "w9"), (None, "w77 w12")]
    items += [(10 + i, " ".join(rng.choices(words, k=12))) for i in range(8)]
    return docs, items


def table(spark, rows, key):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], f"{key} long, text string, terms string, score int")


def test_equal_to_scoring_every_document(spark):
    docs, items = fixture()
    d, i = table(spark, docs, "doc_id"), table(spark, items, "item_id")
    want = plain(docs, items, 20)
    assert sorted(map(tuple, lexical_search.search(d, i).collect()), key=repr) == want
    # Another dealing of the rows, and a group for each item or two.
    again = lexical_search.search(d.repartition(7), i, group_bytes=60)
    assert sorted(map(tuple, again.collect()), key=repr) == want


def test_empty_tables(spark):
    docs, items = fixture(20)
    d, i = table(spark, docs, "doc_id"), table(spark, items, "item_id")
    assert lexical_search.search(d.limit(0), i).count() == 0
    assert lexical_search.search(d, i.limit(0)).count() == 0
    assert lexical_search.search(d, i.where("item_id in (3, 4, 5)")).count() == 0


def test_ranges_below_the_threshold_are_not_scored():
    rng = np.random.default_rng(5)
    docs = [(i, 50, rng.integers(20, 400, 50).tolist()) for i in range(2000)]
    docs[700:730] = [(i, 10, [0, 1, 2, 3, 4] * 2) for i in range(700, 730)]
    part = lexical_search.chunk(docs)
    query = [(np.array([0, 1, 2, 3, 4, 30, 31]), np.ones(7, np.int64))]
    scorer = lexical_search.Scorer(query, np.full(400, 1000), 2000, 99_000, 20)
    scorer.add(part)
    assert sorted(-d for _, d in scorer.best[0]) == list(range(700, 720))
    assert scorer.scored < scorer.seen / 10
