import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from quaver.llm import minimax_shards, token_store, url_filter

SF = "/root/testdata/sf0.001"


def brute_capacity(sizes, shards):
    def fits(capacity):
        used, free = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > free:
                used, free = used + 1, capacity
            free -= s
        return used <= shards

    capacity = 0
    while not fits(capacity):
        capacity += 1
    return capacity


def test_capacity_matches_linear_search():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        sizes = rng.integers(1, 30, n)
        assert minimax_shards.smallest_capacity(sizes, 6) == brute_capacity(sizes.tolist(), 6)


def test_shards_are_contiguous_minimal_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(minimax_shards, "BINS", 4)  # so that bins have to be split
    rows = minimax_shards.op2_minimax_shards(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS key").toPandas()
    both = rows.merge(docs, on="doc_id")
    assert len(rows) == len(docs) and (both.groupby("key")["shard"].nunique() == 1).all()
    assert (both["text_crc32"] == [zlib.crc32(t.encode()) for t in both["text"]]).all()
    groups = both.groupby("key", sort=True)["size"].sum()
    assert rows["capacity"].iloc[0] == minimax_shards.smallest_capacity(groups.to_numpy(), 24)
    assert both.groupby("shard")["size"].sum().max() <= rows["capacity"].iloc[0]
    assert both.sort_values("key")["shard"].is_monotonic_increasing
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_of_hard_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 5000), (3, "é")] + [(i, "same") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", minimax_shards.F.lit("clash"))
    out = minimax_shards.shard_documents(docs, 4).toPandas()
    assert len(out) == len(rows) and out.loc[out["doc_id"] == 3, "size"].tolist() == [10]
    assert out["slot"].notna().all() and out["shard"].between(0, 3).all()
    assert minimax_shards.shard_documents(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_url_verdicts(spark, limit):
    urls = ["http://A.example.net/de/1", "https://a.example.net/de/1/", "http://b.org/x?utm_source=f&b=2&a=1", "http://www.b.org/x.html?a=1&b=2",
            "http://www.example.com/en/3", "http://example.com/en/3#f", "http://x.example.net/es/q", "no scheme", None, "", "http://only.org"]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (3, urls[3])], "page_id long, url string")
    pages = pages.withColumn("host", url_filter.F.lit("clash"))
    out = url_filter.judge(pages, url_filter.respelled(pages), broadcast_bytes=limit)
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in out.collect()}
    assert {(0, None, "block"), (2, None, "block"), (4, "www.example.com/en/", "allow"), (5, "example.com/en/", "block"),
            (6, "net/es/", "block"), (7, None, "allow"), (8, None, "allow"), (10, None, "allow"), (None, None, "block")} <= got
    assert out.count() == len(urls) + 2
    assert url_filter.judge(pages.limit(0), url_filter.respelled(pages)).count() == 0


def test_urls_match_sql(spark):
    assert not differences(url_filter.op3_url_filter(spark, SF), connect(SF), url_filter.OP3_SQL)


def test_segment_round_trip():
    rng = np.random.default_rng(1)
    for n, longest in ((1, 50), (7, 50), (256, 1), (257, 9000), (300, 50), (2000, 3)):
        lengths = np.maximum(rng.integers(0, longest, n), rng.random(n) < 0.5)
        ends = np.cumsum(lengths)
        ids = rng.integers(0, 50257, ends[-1])
        segment = token_store.Segment(token_store.pack(ends, ids))
        starts, found = segment.spans(0, n)
        assert (found == ends).all() and (starts == [0, *ends[:-1]]).all() and (segment.ids == ids).all()
        assert [segment.span(i) for i in range(n)] == list(zip([0, *ends[:-1]], ends))
        some = np.unique(rng.integers(0, n, 9))
        assert (segment.select(some) == ends[some]).all()


def test_store_equals_plain_encoding(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    hard = [None, "", "  two  spaces ", "a\n b\t c", "<|endoftext|> x", "it's  don't you　ok", " lead", "x" * 3000, "naïve   line"]
    rows = [(i, t) for i, t in enumerate(hard)] + [(None, "null id"), (2, "again")]
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = spark.createDataFrame(rows + [(2, "again")], "doc_id long, text string").union(texts.selectExpr("doc_id + 100", "text"))
    docs = docs.withColumn("start", token_store.F.lit("clash"))
    where = f"file://{tmp_path}/store"
    token_store.write_store(docs, where, path)
    out = token_store.read_store(spark, where).toPandas().sort_values("start")
    plain = Tokenizer.from_file(path)
    expected = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
        for r in docs.collect()
    )
    assert sorted(zip(out["doc_id"].fillna(-1), out["ids_crc32"])) == expected
    assert out["doc_id"].fillna(-1).is_monotonic_increasing
    assert (out["start"].to_numpy() == np.cumsum([0, *out["n_tokens"]])[:-1]).all()
    token_store.write_store(docs.limit(0), where + "0", path)
    assert token_store.read_store(spark, where + "0").count() == 0


def test_a_tokenizer_that_cuts_otherwise_is_left_to_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["It's  two words, ISN'T it? 12345 x_y", "\tNo\n lines", "", "don't!! " * 40, "Ünï 日本 <b>"]
    encoder, plain = token_store.CachedEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        assert [list(x) for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_file_with_a_normaliser_is_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, normalizers

    changed = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    changed.normalizer = normalizers.Lowercase()
    changed.save(str(tmp_path / "t.json"))
    encoder = token_store.CachedEncoder(str(tmp_path / "t.json"))
    assert not encoder.known and token_store.CachedEncoder(public_tokenizers.path("byte_bpe_50k.json")).known
    assert list(encoder.encode(["Some UPPER Words"])[0]) == changed.encode("Some UPPER Words").ids


def test_very_long_urls(spark):
    long = "http://Example.com/en/" + "a" * 300_000
    pages = spark.createDataFrame([(1, long), (2, long + "?" + "q" * 100_000), (3, "x" * 200_000), (4, "http://" + "h" * 150_000)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], len(r["path"]), r["rule"]) for r in url_filter.judge(pages, url_filter.respelled(pages.limit(0))).collect()}
    assert got == {1: ("example.com", 300_004, "example.com/en/"), 2: ("example.com", 300_004, "example.com/en/"), 3: ("", 0, None), 4: ("h" * 150_000, 0, None)}
