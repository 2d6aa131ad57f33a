import re
from itertools import permutations

from quaver.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    def fails(letter, row, position):
        doc_id, text, _ = row
        text, words = text or "", WORD.findall(text or "")
        if letter == "A":
            return len(words) < 100
        if letter == "B":
            return 100 * len(set(words)) < 80 * len(words)
        if letter == "C":
            return 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)
        if letter == "D":
            return re.search("[#$%&*|]", text) is not None
        return doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)

    failing = [{c for c in "ABCDE" if fails(c, row, i)} for i, row in enumerate(docs)]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows, shares = {}, {}
    for part in {p or "" for _, _, p in docs}:
        inside = [i for i, (_, _, p) in enumerate(docs) if (p or "") == part]
        for order in permutations("ABCDE"):
            alive = set(inside)
            for step, c in enumerate(order, 1):
                gone = {i for i in alive if c in failing[i]}
                redundant = sum(c in failing[i] for i in inside) - len(gone)
                alive -= gone
                only = sum(failing[i] == {c} for i in inside)
                lost = [sum(docs[i][0] in s for i in gone) for s in (good, toxic)]
                rows[part, "".join(order), step] = [len(alive), len(gone), redundant, only, *lost]
                shares[part, c] = shares.get((part, c), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def fixture():
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "a", long, long, long, long.upper(), long + " $", "a " * 200, "A# " * 30, long + " x", "é ü " * 60, "b\x0bc\x1cd " * 150, "w" * 5000, long + " $"]
    docs = [(i, t, ["en", None, "de", ""][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, long, "en"), (3, long, "de"), (None, long, "en"), (None, None, None), (20, long, "fr"), (20, long, "fr"), (21, "only\n| one", "fr")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 22, 2)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (4, None, None), (99, 1, 1)]
    return docs, labels


def table(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash", 7) for r in docs], "doc_id long, text string, lang string, mask string, n int")
    lab = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, text string")
    return d, lab


def test_all_orders_against_filters_applied_in_turn(spark):
    docs, labels = fixture()
    out = filter_audit.audit(*table(spark, docs, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in out}
    assert len(out) == len(got) == 4 * 600
    assert got == plain(docs, labels)


def test_a_text_with_very_many_copies(spark):
    docs = [(i, "copy " * 10 if i % 3 else f"own {i}", "en") for i in range(900)]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in filter_audit.audit(*table(spark, docs, [])).collect()}
    assert got["en", "EABCD", 1] == (301, 599, 0, 0, 0, 0, got["en", "EABCD", 1][-1])
    assert got["en", "AEBCD", 2][:3] == (0, 0, 599)


def test_empty_table(spark):
    assert filter_audit.audit(*table(spark, [], [(1, 1, 1)])).count() == 0
