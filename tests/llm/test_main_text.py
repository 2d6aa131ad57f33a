import re
from html import unescape

import numpy as np
from pyspark.sql import functions as F
from quaver.llm import main_text

SF = "/root/testdata/sf0.001"


def test_articles_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = main_text.op8_main_text(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = [" ".join(unescape(re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"].split("\n") == [b for b in blocks if b] and r["n_chars"] == len(r["text"])


def test_blocks():
    html = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><header>Site</header><div class="cookie-notice">We use</div>
    <nav><a>Menu</a></nav><main><h1>Head&amp;line</h1><p>One&nbsp; two<br>three<p>Four <b>five</b></p><aside>Side</aside><div class="comments"><p>me too</p></div>
    <ul><li>a<li>b</ul><form><input>Go</form><style>p{}</style><!-- no --></main><footer>&copy; me</footer></body>"""
    got = main_text.blocks_of(html)
    assert [t for k, t in got if k == main_text.ARTICLE] == ["Head&line", "One two three", "Four five", "a", "b"]
    assert not [t for k, t in got if k == main_text.REST]
    assert [t for k, t in main_text.blocks_of("<div class=ad>x<article><p>y</article>z")] == ["x", "y", "z"]


def test_suffix_classes_match_brute_force():
    rng = np.random.default_rng(8)
    for run in (3, 5, 8):
        for _ in range(20):
            sizes = rng.integers(0, 40, 8)
            tokens, page = rng.integers(0, 3, sizes.sum()), np.repeat(np.arange(8), sizes)
            places, classes = main_text.suffix_classes(tokens, page, run)
            assert places.tolist() == [i for i in range(len(tokens) - run + 1) if page[i] == page[i + run - 1]]
            prefixes = [tuple(tokens[i : i + run].tolist()) for i in places]
            assert len(set(zip(prefixes, classes.tolist()))) == len(set(prefixes)) == len(set(classes.tolist()))


def plain_texts(rows):
    """The module's rule word by word, over (page_id, url, html) rows."""
    run, least = main_text.MIN_RUN, main_text.MIN_PAGES
    parsed = [main_text.blocks_of(html or "") for _, _, html in rows]
    hosts = [re.sub(r"(?s)^.*?://([^/?#]*).*$", r"\1", url).lower() if url and "://" in url else "" for _, url, _ in rows]
    streams = [[(w.lower(), b) for b, (_, text) in enumerate(blocks) for w in text.split()] for blocks in parsed]
    where = {}
    for i, stream in enumerate(streams):
        name = tuple((w, parsed[i][b][0]) for w, b in stream)
        for s in range(len(stream) - run + 1):
            part = stream[s : s + run]
            inside = any(parsed[i][b][0] == main_text.ARTICLE for _, b in part)
            pages = where.setdefault((hosts[i], tuple(w for w, _ in part)), {})
            pages[name] = pages.get(name, False) or inside
    host_pages = {}
    for i, stream in enumerate(streams):
        host_pages.setdefault(hosts[i], set()).add(tuple((w, parsed[i][b][0]) for w, b in stream))
    out = []
    for i, stream in enumerate(streams):
        article = any(k == main_text.ARTICLE for k, _ in parsed[i])
        gone = [False] * len(stream)
        for s in range(len(stream) - run + 1):
            pages = where[(hosts[i], tuple(w for w, _ in stream[s : s + run]))]
            inside = sum(pages.values())
            everywhere = 2 * (len(pages) - inside) >= len(host_pages[hosts[i]])
            if len(pages) >= least and (everywhere if article else 2 * inside < len(pages)):
                gone[s : s + run] = [True] * run
        kept = []
        for b, (kind, text) in enumerate(parsed[i]):
            left = [g for (_, at), g in zip(stream, gone) if at == b]
            if article and kind == main_text.ARTICLE and not all(left):
                kept.append(text)
            if not article and kind == main_text.REST and not all(left):
                kept.append(" ".join(w for w, g in zip(text.split(), left) if not g))
        out.append("\n".join(kept))
    return out


def texts(pages, size, **more):
    return {r["page_id"]: r["text"] for r in main_text.main_texts(pages, size, **more).collect()}


def test_the_array_decides_inside_articles(spark):
    notice = "this site keeps small files on your machine to count its readers"
    quote = "all that glitters is not gold often have you heard that told"
    rows = [(i, f"http://h.org/{i}", f"<div>{notice}</div><article><p>own{i} words{i}</p><p>{quote}</p></article>") for i in range(5)]
    rows += [(5, "http://H.org/5", f"<article><p>own5 words5</p><p>{notice}</p><p>{quote}</p><p>as they say: {notice} again</p></article>")]
    rows += [(6, "http://other.org/6", f"<article><p>{notice}</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_array = {i: f"own{i} words{i}\n{quote}" for i in range(5)} | {5: f"own5 words5\n{quote}\nas they say: {notice} again", 6: notice}
    for size in (1 << 20, 200, 1):
        assert texts(pages, size) == with_array == dict(zip(range(7), plain_texts(rows)))
    assert texts(pages, 1 << 20, array=False)[5] != with_array[5]


def test_a_whole_host_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    by_host = {}
    for r in table:
        by_host.setdefault(r["url"].split("/")[2].lower() if r["url"] and "://" in r["url"] else "", []).append((r["page_id"], r["url"], r["html"]))
    rows = max(by_host.values(), key=len)
    # The same pages without their article's mark, and the site's notice within some articles.
    footer = re.search(r"(?s)<footer>(.*?)</footer>", rows[0][2])[1]
    rows = rows + [(r[0] + 10**6, r[1], re.sub("</?article>", "", r[2])) for r in rows[::2]]
    rows = rows + [(r[0] + 2 * 10**6, r[1], r[2].replace("</article>", f"<p>{footer} {footer}</p></article>")) for r in rows[:9]]
    rows = [(r[0], r[1], r[2].replace("<footer>", f"<footer>{footer} {footer} ")) for r in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert texts(pages, 20_000) == dict(zip([r[0] for r in rows], plain_texts(rows)))


def test_pages_without_article(spark):
    menu = "home news sport weather travel music books games"
    rows = [(i, f"http://h.org/{i}", f"<div>{menu}</div><p>one{i} two{i} three{i} four{i}</p><div>{menu} {i}</div>") for i in range(5)]
    rows += [(5, "http://h.org/5", None), (6, None, ""), (None, "http://other.org/", f"<p>{menu}"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    for size in (1 << 20, 1):
        out = sorted(main_text.main_texts(pages, size).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
        assert [r["text"] for r in out] == [f"one{i} two{i} three{i} four{i}\n{i}" for i in (0, 0, 1, 2, 3, 4)] + ["", "", menu]
    assert main_text.main_texts(pages.limit(0)).count() == 0


def test_copies_count_as_one_page(spark):
    rows = [(i, f"http://h.org/c{i}", "<p>a b c d e f g h copy</p>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 20, 1):
        assert set(texts(pages, size).values()) == {"a b c d e f g h copy"}


def test_names_inside_articles_and_deep_pages():
    slugs = '<article><section id="related-work"><h2 id="social-history">x</h2><p class="ad-hoc">y</p><p class="big ad">z</p></section></article>'
    assert [t for k, t in main_text.blocks_of(slugs) if k == main_text.ARTICLE] == ["x", "y"]
    deep = "<div><span>" * 50_000 + "end" + "<p>" * 50_000 + "x" * 1_000_000
    assert [t[:3] for _, t in main_text.blocks_of(deep)] == ["end", "xxx"]


def test_names_vote_by_all_their_words():
    inside = '<article><p>text of it</p><div id="comments">c1</div><ul class="comment-list"><li>c2</ul><div class="ad-slot">c3</div><div class="x cookie-notice">c4</div><div id="adSlot2">c5</div></article>'
    assert [t for k, t in main_text.blocks_of(inside) if k == main_text.ARTICLE] == ["text of it"]
    for name in ('class="social-history"', 'class="modal-verbs"', 'id="share-price-report"', 'id="related-work"', 'class="menu-of-the-day"', 'class="widget"', 'id="Comments"'):
        page = f"<body><nav>n</nav><div {name}><h1>head</h1><p>whole text</p></div></body>"
        assert [t for k, t in main_text.blocks_of(page) if k == main_text.REST] == ["head", "whole text"]
    page = '<div><p>some words of the page</p></div><div class="commentThread"><p>reader says much more than the page itself does, as readers do</p></div>'
    assert [t for k, t in main_text.blocks_of(page) if k == main_text.REST] == ["some words of the page"]
    assert [t for k, t in main_text.blocks_of('<article><h2 id="comments">On comments</h2><div class="widget"><p>all</p></div></article>') if k == main_text.ARTICLE] == ["On comments"]
