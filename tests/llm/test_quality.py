import re

from pyspark.sql import functions as F
from quaver.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_upper": len(re.findall("[A-Z]", text)),
        "n_letters": len(re.findall("[A-Za-z]", text)), "n_exclaim": text.count("!"),
    }


def failing(m):
    checks = [
        m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 100 * m["n_symbols"] > 5 * m["word_chars"], 100 * m["n_upper"] > 40 * m["n_letters"],
        100 * m["n_exclaim"] > 30 * m["n_words"], 100 * m["n_dup_lines"] > 50 * m["n_lines"], m["word_chars"] > 20 * m["n_words"],
    ]
    return sum(1 << b for b, c in enumerate(checks) if c)


def rows(spark):
    distinct = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a", distinct, distinct, "SHOUT " * 60, "x! " * 60, "same line here\n" * 40]
    texts += ["é ü z 😀 #$", "w" * 2000, " ".join(f"v{i % 5000}" for i in range(20_000)), "#%& " * 70]
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, failed_bits int")


def test_measurements_and_bits(spark):
    table = rows(spark)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    out = quality.ledger(table).collect()
    assert len(out) == len(texts)
    for r in out:
        if len(texts[r["doc_id"]] or "") < 50_000:
            want = plain(texts[r["doc_id"]])
            assert {k: r[k] for k in want} == want and r["failed_bits"] == failing(want)
        else:
            assert (r["n_words"], r["n_repeat_words"]) == (20_000, 20_000)
    assert quality.ledger(table.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    ledger = quality.ledger(rows(spark)).select("doc_id", "failed_bits").cache()
    bits = [r["failed_bits"] for r in ledger.collect()]
    for policy in quality.POLICIES:
        kept = quality.apply_policy(ledger, policy).where("kept").count()
        assert kept == sum(not b & quality.mask(policy) for b in bits)
        for r in quality.ablation(ledger, policy).collect():
            own = next(1 << b for b, name, _ in quality.RULES if name == r["rule"])
            assert r["n_failed"] == sum(b & own > 0 for b in bits)
            assert r["n_only"] == sum(b & quality.mask(policy) == own for b in bits)
    assert {r["rule"] for r in quality.ablation(ledger, "strict").collect()} == {name for _, name, _ in quality.RULES}
    assert quality.ablation(ledger.where(F.lit(False)), "base").count() == 0
