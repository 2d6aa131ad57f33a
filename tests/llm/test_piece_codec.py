import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from quaver.llm import piece_codec

SF = "/root/testdata/sf0.001"


def plain_viterbi(vocabulary, text):
    best = [(0.0, ())] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - vocabulary.longest), j):
            part = text[i:j]
            if part in vocabulary.pieces:
                step, ids = vocabulary.pieces[part][1], (vocabulary.pieces[part][0],)
            elif j == i + 1:
                step, ids = vocabulary.unknown, tuple(vocabulary.byte_ids[b] for b in part.encode())
            else:
                continue
            value = best[i][0] + step
            if best[j] is None or value > best[j][0]:
                best[j] = (value, best[i][1] + ids)
    return best[-1]


def test_streaming_equals_full_viterbi():
    rng = random.Random(4)
    for round_ in range(60):
        names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(12)} | {"a", "b"}
        vocabulary = piece_codec.Pieces({s: (1000 + k, -rng.random() * 9) for k, s in enumerate(sorted(names))}, list(range(256)))
        text = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 200)))
        assert tuple(piece_codec.viterbi_stream(vocabulary, text)) == plain_viterbi(vocabulary, text)[1], (round_, text)


def test_pairs_and_ids_equal_merging():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library, rng = piece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    vocabulary = codec.vocabulary
    assert vocabulary.merges and len(vocabulary.pieces) > 31_000
    inner = [s for s in vocabulary.pieces if " " not in s]
    for _ in range(5000):
        a, b = rng.choice(inner), rng.choice(inner)
        assert vocabulary._stay(a, b) == (piece_codec.merged(vocabulary.scores, a + b) == [a, b])
    bits = ["a", "b", "th", "e", " ", "  ", "\n", "é", "1", "00", "=", "日", "😀", "ing"]
    hard = ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(500)]
    hard += ["a" + " " * 200, " " * 33 + "\n   x", "a" * 20_000, "ab\n" * 9000, "x " * 9000, "<s> </s> <0x0A>", " " * 15]
    for text in hard:
        assert codec.encode(text).tolist() == library.encode(text) and codec.decode(codec.encode(text)) == text


def test_codec_round_trip_and_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    hard = [None, "", " ", "  a  b ", "▁ mark", "tab\tnew\nline", "😀 é", "z" * 500, "x y" * 90, "\x00"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(hard)] + [(None, "n", 1), (2, " ", 1)], "doc_id long, text string, n_ids long")
    texts = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(2).cast("long").alias("n_ids"))
    docs = docs.union(texts)
    out = piece_codec.encode(docs, path)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    back = {(r["doc_id"], r["text"]) for r in piece_codec.decode(out.select("doc_id", "ids"), path).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in out.collect():
        assert any(library.encode(t or "") == r["ids"] or piece_codec.MARK in (t or "") for d, t in texts if d == r["doc_id"])
    assert piece_codec.encode(docs.limit(0), path).count() == 0
