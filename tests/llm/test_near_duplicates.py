import numpy as np
import xxhash
from compare import connect, differences
from pyspark.sql import functions as F
from quaver.llm import decontaminate, simhash
from quaver.llm.common import stored

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(fps))]


def test_triples_cover():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_matches_brute_force(spark):
    hard = [(None, None), (5000, ""), (5001, "a b"), (5002, "A b"), (5002, "x" * 9000), (None, "a B"), (5003, "a b c d"), (5004, " \n")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(hard, "doc_id long, text string"))
    docs = docs.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(map(repr, zip([r["doc_id"] for r in rows], fps, plain_components(fps, [r["doc_id"] for r in rows]))))
    out = simhash.near_duplicates(stored(simhash.fingerprints(docs), "t")).collect()
    assert sorted(repr((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in out) == want
    assert simhash.near_duplicates(stored(simhash.fingerprints(docs.limit(0)), "t")).count() == 0


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6).tolist()
    fps = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(60)}
    fps |= set(rng.integers(0, 2**63, 200).tolist())
    fps = sorted(fps)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    out = dict(simhash.near_duplicates(stored(rows, "t")).select("doc_id", "component_id").collect())
    want = plain_components(fps, list(range(len(fps))))
    assert [out[i] for i in range(len(fps))] == want
    # Postings split down to a few fingerprints find what whole ones do.
    distinct = stored(rows.select("fp"), "t")
    whole, split = [{r["node"]: r["root"] for r in simhash.components(simhash.link_edges(distinct, n)).collect()} for n in (4096, 3)]
    assert whole == split and len(whole) == sum(want.count(c) > 1 for c in want)


def test_keys_that_a_third_of_rows_share(spark):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("_n"), F.max("v").alias("m"))
    got = sorted(map(tuple, simhash.with_heavy(left, right, "k", 3000).collect()))
    assert got == sorted((0 if i % 3 == 0 else i, i, 2997 if i % 3 == 0 else i) for i in range(3000))
    hub = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(500, 501), (501, 502)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(hub).collect()} == {i: 0 for i in range(400)} | {i: 500 for i in (500, 501, 502)}


def test_decontamination_matches_sql(spark):
    assert not differences(decontaminate.op7_decontaminate(spark, SF), connect(SF), decontaminate.OP7_SQL)


def test_decontamination_of_hard_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (1, long), (2, "short one"), (None, "no id here"), (3, None), (4, ""), (5, "W5, w6")]
    docs = [(1, "pre " + " ".join(f"W{i}" for i in range(3, 16)) + " post"), (1, " ".join(f"w{i}" for i in range(3, 15))),
            (2, "a short. ONE, no id here"), (None, None), (3, ""), (4, "w5 w6 " * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    frame = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(docs)], "doc_id long, row long, text string")
    whole = {r["row"]: r for r in decontaminate.find_contamination(frame, bench).collect()}
    blocks = {r["row"]: r for r in decontaminate.find_contamination(frame, bench, block_bytes=40).collect()}
    assert whole == blocks
    assert [(whole[i]["n_words"], whole[i]["n_hit"], whole[i]["items"]) for i in range(6)] == [
        (15, 13, ["1", "5"]), (12, 2, ["5"]), (6, 5, ["", "2"]), (0, 0, []), (0, 0, []), (800, 800, ["5"])]
    assert decontaminate.find_contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(frame.limit(0), bench).count() == 0


def test_decontamination_of_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    text = " ".join(f"w{i % 977}" for i in range(150_000)) + " " + item.upper()
    docs = spark.createDataFrame([(1, 1, text), (2, 2, item)], "doc_id long, row long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (150_030, 30, ["7"]), 2: (30, 30, ["7"])}
