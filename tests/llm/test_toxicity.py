import random
import re

import numpy as np
from pyspark.sql import functions as F
from quaver.llm import toxicity
from quaver.llm.toxicity import Examples, Index

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    out = {}
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        for term in [w, *[(n, w[:n]) for n in toxicity.STEMS if len(w) > n]]:
            out[term] = out.get(term, 0) + 1
    return out


class PlainModel:
    """The module's rule with dictionaries, over the same sample."""

    def __init__(self, docs, labels):
        sample, counts = toxicity._sample(docs, labels)
        rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
        self.known = {}
        self.examples = [(r["doc_id"], r["toxic"], plain_terms(r["text"])) for r in rows]
        texts = [plain_terms(r["text"]) for r in docs.collect()]
        frequency = {}
        for t in texts:
            for term in t:
                frequency[term] = frequency.get(term, 0) + 1
        vocabulary = {term for _, _, t in self.examples for term in t}
        self.idf = {term: np.log((1 + len(texts)) / (1 + frequency[term])) for term in vocabulary}
        seen = [sum(e[1] == k for e in self.examples) for k in (0, 1)]
        share = [counts.get(k, 0) / max(1, seen[k]) for k in (0, 1)]
        votes, self.kept_alive = [], []
        for fold in range(toxicity.FOLDS):
            others = [e for i, e in enumerate(self.examples) if i % toxicity.FOLDS != fold]
            weights = self.relevance(others)
            self.kept_alive.append(weights)
            for _, toxic, own in self.examples[fold :: toxicity.FOLDS]:
                near = self.nearest(others, weights, own)
                if near:
                    votes.append((self.vote(near), toxic, share[toxic]))
        self.calibration = toxicity.monotone(*np.array(sorted(votes)).T)
        self.weights = self.relevance(self.examples)

    def relevance(self, examples):
        seen = [{}, {}]
        for _, toxic, own in examples:
            for term in own:
                seen[toxic][term] = seen[toxic].get(term, 0) + 1
        n = sum(e[1] for e in examples)
        even = (len(examples) - n) / max(1, n)
        return {t: i * np.log2(2 + seen[1].get(t, 0) * even / max(1, seen[0].get(t, 0))) ** 2 for t, i in self.idf.items()}

    def nearest(self, examples, weights, own):
        def vector(terms, known=self.known):
            if (key := (id(weights), id(terms))) in known:
                return known[key]
            v = {t: (1 + np.log(c)) * weights[t] for t, c in terms.items() if t in weights}
            length = np.sqrt(sum(x * x for x in v.values()))
            known[key] = {t: x / length for t, x in v.items()} if length else v
            return known[key]

        mine = vector(own)
        found = []
        for doc_id, toxic, terms in examples:
            other = vector(terms)
            cosine = sum(x * other.get(t, 0.0) for t, x in mine.items())
            if cosine > 1e-9:
                found.append((cosine, toxic, doc_id))
        self.known.pop((id(weights), id(own)), None)
        return sorted(found, key=lambda f: (-round(f[0], 6), f[2]))[: toxicity.NEIGHBOURS]

    @staticmethod
    def vote(near):
        w = [1 / (1.1 - min(c, 1)) for c, _, _ in near]
        return sum(x * t for x, (_, t, _) in zip(w, near)) / sum(w)

    def score(self, text):
        near = self.nearest(self.examples, self.weights, plain_terms(text))
        return float(np.interp(self.vote(near) if near else 0.0, *self.calibration))


def test_scores_equal_a_plain_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = PlainModel(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op4_toxicity(spark, SF).collect()
    assert len(rows) == len(texts) and sum(len(r["neighbours"]) > 0 for r in rows) > 0.95 * len(rows)
    for r in rows:
        assert abs(r["score"] - model.score(texts[r["doc_id"]])) < 1e-3
        near = model.nearest(model.examples, model.weights, plain_terms(texts[r["doc_id"]]))
        assert np.allclose([n["similarity"] for n in r["neighbours"]], [c for c, _, _ in near[:3]], atol=1e-5)


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    terms = [np.sort(rng.choice(40, rng.integers(0, 6), replace=False)) for _ in range(500)]
    cut = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    examples = Examples(np.arange(500), (rng.random(500) < 0.5).astype(np.int64), cut, np.concatenate(terms), rng.integers(1, 4, cut[-1]), (2.0, 1.0))
    index = Index(examples, 1 + rng.random(40))
    dense = np.zeros((500, 40))
    for k, d in enumerate(index.doc_ids):
        at = examples.row(int(d))
        dense[k, examples.term[at]] = index.weight(examples.term[at], examples.count[at])
    for _ in range(50):
        term = np.sort(rng.choice(40, 4, replace=False))
        weight = index.weight(term, rng.integers(1, 4, 4))
        cosines = dense[:, term] @ weight
        best, got = index.nearest(term, weight)
        assert np.allclose(got, np.sort(cosines)[::-1][: len(got)], atol=1e-6) and len(got) == min(15, (cosines > 0).sum())
        assert np.allclose(cosines[best], got, atol=1e-6)


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert list(y) == sorted(y) and y[0] == 0 and y[-1] == 1


def test_monotone_fit_of_tied_votes():
    # Votes of 0 and 1 alone, one clean example among those of 1, as on large tables of like texts.
    x, y = toxicity.monotone(np.array([0.0] * 5 + [1.0] * 5), np.array([0.0] * 6 + [1.0] * 4), np.ones(10))
    assert list(x) == [0, 1] and np.allclose(y, [0, 0.8])
    x, y = toxicity.monotone(np.array([0.0, 0.0, 0.5, 0.5, 1.0, 1.0]), np.array([0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), np.array([1.0, 1, 1, 1, 1, 3]))
    assert np.allclose(np.interp([0, 0.5, 1], x, y), [0.25, 0.25, 0.75])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    hit = rows[(rows["predicted"] == 1) & (rows["toxic"] == 1)]
    wrong = ((rows["predicted"] == 1) & (rows["toxic"] == 0)).sum()
    assert len(hit) >= 0.94 * (rows["toxic"] == 1).sum() and wrong <= 0.02 * (rows["toxic"] == 0).sum()
    assert rows["score"].between(0, 1).all()


def test_toxicity_of_hard_rows(spark):
    texts = [(i, f"plain words number {i}") for i in range(60)] + [(i, f"vile words number {i}") for i in range(60, 120)]
    docs = spark.createDataFrame([*texts, (None, None), (200, ""), (200, "vile"), (201, "vile " * 5000)], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, 0, int(i >= 60)) for i in range(120)] + [(None, 0, 1), (1, 0, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 124
    assert [r["predicted"] for r in out if r["doc_id"] == 201] == [1] and [r["predicted"] for r in out if r["doc_id"] is None] == [0]
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_only_true_copies_leave_the_sample(spark):
    rng = random.Random(7)
    words = [f"longword{k:04d}" for k in range(400)]
    rows = [(i, i % 2, " ".join(rng.sample(words, 60))) for i in range(300)]
    near = [(1000 + i, i % 2, f"{rows[i][2]} anotherword") for i in range(20)]
    sample = spark.createDataFrame(rows + near + [(2000 + i, 0, "short ones") for i in range(3)], "doc_id long, toxic int, text string")
    left = [r["doc_id"] for r in toxicity._without_copies(sample).collect()]
    assert sorted(left) == [*range(300), 2000, 2001, 2002]


def test_one_text_of_an_id_and_bytes_bound_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, f"text {'long ' * 200} {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "_without_copies", lambda sample: sample)
    assert toxicity._sample(docs, labels)[0].count() == len({r["doc_id"] for r in toxicity.training_rows(labels).collect()})
    monkeypatch.setattr(toxicity, "MAX_BYTES", 1500)
    assert toxicity._sample(docs, labels)[0].groupBy("toxic").count().where("count > 1").count() == 0
