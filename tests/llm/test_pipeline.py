import corpus_pipeline
import duckdb
from compare import connect
from quaver.llm import decontaminate, quality, toxicity
from quaver.llm.common import read, stored

from tests.llm.test_near_duplicates import plain_components, plain_fingerprint
from tests.llm.test_toxicity import PlainModel

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_stages(spark):
    con = connect(SF)
    docs = stored(read(spark, SF, "documents"), "test")
    keep = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP5_SQL}) WHERE kept").fetchall()}
    kept = stored(corpus_pipeline.keep_quality(spark, docs, SF), "test")
    assert {r["doc_id"] for r in kept.collect()} == keep and kept.columns == docs.columns
    model = PlainModel(kept, read(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] for r in kept.collect() if model.score(r["text"]) < toxicity.THRESHOLD}
    mild = stored(corpus_pipeline.drop_toxic(spark, kept, SF), "test")
    assert {r["doc_id"] for r in mild.collect()} == set(texts) and mild.columns == docs.columns
    ids = sorted(texts)
    groups = plain_components([plain_fingerprint(texts[d]) for d in ids], ids)
    single = stored(corpus_pipeline.drop_near_duplicates(spark, mild, SF), "test")
    assert {r["doc_id"] for r in single.collect()} == set(groups) and single.columns == docs.columns
    frame = single.select("doc_id", "text").toPandas()
    own = duckdb.connect()
    own.register("documents", frame)
    own.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    clean = {r[0] for r in own.execute(f"SELECT doc_id FROM ({decontaminate.OP7_SQL}) WHERE NOT contaminated").fetchall()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == clean and len(out) == len(clean) and all(r["round_trip"] for r in out)
    assert 0 < len(clean) < len(ids) <= len(keep) < docs.count()


def test_pipeline_of_hard_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", "en", "s", 3)] + [(i, " ".join(f"word{j}" for j in range(60)), "en", "s", 9) for i in (7, 5, 5)]
    where = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, where).collect()] == [5]
