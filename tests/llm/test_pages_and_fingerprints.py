import hashlib
import html
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import line_blocks, rare_features
from tests.llm.helpers import frame, odd_rows

# ---- pages ----


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("<article>", ""), ("<!-- x", ""), ("<script>x", ""), ("a<b", "a<b"),
    ('<p class="ad">x<p>y', "y"), ("<div><p>tiny</p></div>", "tiny"),
    ("<nav>menu</nav><article><h1>T &amp; &lt;x&gt;</h1><p>a\n b&nbsp;<b>c</b>d<br>e</article><footer>f</footer>", "T & <x>\na b cd e"),
    ('<article><header><h1>Head</h1><p>by me</header><p>one</p><div class="advert">buy</div><aside>side</aside><ul><li>x<li>y</ul>'
     '<form><p>name<input></form><p>two<section id="comments"><p>hi</section></article>', "Head\none\nx\ny\ntwo"),
    ('<main><p>a</p><script>if (a<b) {"</p><p>no"}</script><style>p{}</style><p title="a>b">c</main><p>late', "a\nc"),
    ("<div role=navigation>x</div><div><p>" + "word " * 40 + "</p><p>short</p><p>" + "more " * 30 + "</p></div><div class=sidebar>s</div>",
     ("word " * 40).strip() + "\nshort\n" + ("more " * 30).strip()),
    ("<article><p>x<nav>open<p>still</article><p>after", "x"), ("<article>&#233;&#x1F600;&eacute &am &amp</article>", "é😀é &am &"),
])
def test_pages(page, text):
    assert line_blocks.main_text(page) == text


BODY = "<article><h1>Title</h1><p>First words of it.</p><p>{}</p><p>And the end.</p>{}</article>"
TEXT = "Title\nFirst words of it.\n" + ("long " * 40).strip() + "\nAnd the end."


@pytest.mark.parametrize("extra", [
    '<section class="post-comments"><h3>2 comments</h3><p>I do not agree at all with this, not at all.</p></section>',
    '<div class="entry-comments"><div><p>Nice one, thank you so much for writing it.</p></div><p>Me too.</p></div>',
    '<div class="content-footer"><p>Filed under many things, posted by someone</p></div>', '<div id="main-nav"><p>Home and more</p></div>',
    '<ol class="comment-list"><li><article class="comment"><p>First comment here</p></article></li>'
    '<li><article><p>Second comment here</p></article></li></ol>',
    '<ul><li class="comment"><div><p>One</p><ul><li class="comment">two<li>three</ul></div><li class="comment even">four</ul>',
    '<article class="comment depth-1"><p>A comment marked as an article of its own</p></article>',
    '<div class="post-share"><p>Share this with all your friends right now</p></div>', '<p><a href="/next">Next article about something else</a></p>',
    '<table><tr class="ad"><td><p>buy</p></td><td><table><tr><td>this</table></td></tr></table>',
])
def test_comments_footers_and_menus_are_left_out(extra):
    page = "<body>" + BODY.format("long " * 40, extra) + "</body>"
    assert line_blocks.main_text(page) == TEXT
    assert line_blocks.main_text(page.replace(extra + "</article>", "</article>" + extra)) == TEXT
    main = BODY.replace("article>", "main>").format("long " * 40, extra)
    assert line_blocks.main_text(f"<body>{main}</body>") == TEXT


def test_names_that_belong_to_the_article():
    assert line_blocks.main_text('<article class="post type-post comments-open"><p>text of the post</p></article>') == "text of the post"
    assert line_blocks.main_text('<div class="entry content has-sidebar"><p>some text</p></div>') == "some text"
    assert line_blocks.main_text(
        '<article><div class="entry-header"><h1>Head</h1><p>by me</p></div><p>The text of it.</p></article>') == "Head\nThe text of it."


def plain_stretches(sizes, width):
    """Lines between surge and dive by the definition: a line is inside if some window sum over it is not nothing."""
    sums = [sum(sizes[i:i + width]) for i in range(len(sizes))]
    out, run = [], []
    for i in range(len(sums) + 1):
        if i < len(sums) and sums[i]:
            run.append(i)
        elif run:
            lines = [j for j in range(run[0], min(run[-1] + width, len(sizes))) if sizes[j]]
            out.append((range(lines[0], lines[-1] + 1), max(sums[j] for j in run)))
            run = []
    return out


def test_stretches_against_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(400):
        sizes = [int(x) for x in rng.integers(0, 90, rng.integers(0, 25)) * (rng.random(1) < rng.random(1))]
        sizes = [x if rng.random() < 0.5 else 0 for x in sizes]
        for width in (1, 2, 3, 5):
            assert line_blocks._stretches(sizes, width) == plain_stretches(sizes, width)


def test_many_articles_take_linear_time():
    import time

    def took(n):
        start = time.process_time()
        text = line_blocks.main_text("<body>" + "<article><h2>Card</h2><p>teaser number of a page</p></article>" * n)
        assert text.count("\n") == 2 * n - 1
        return time.process_time() - start

    took(500)
    assert took(8000) < 40 * max(took(500), 0.01)


@pytest.mark.parametrize("card", ["<article><h2><a>Next</a></h2><p>a teaser of another page</p></article>",
                                  "<main><p>" + "card " * 30 + "</main>", "<article><p>" + "one long line " * 12 + "</article>" * 2])
def test_an_article_that_is_a_teaser_does_not_hide_the_body(card):
    body = [("body " * 40).strip(), "short line", ("more " * 30).strip(), ("last " * 25).strip()]
    blocks = "".join(f"<p>{b}</p>" for b in body)
    alone = [line_blocks.main_text(f"<div>{blocks}</div>"), line_blocks.main_text(card)]
    assert alone[0] == "\n".join(body)
    for page, parts in ((f"<div>{blocks}</div>{card}", alone), (f"{card}<div>{blocks}</div>", alone[::-1]),
                        (f"{card}<nav>x</nav><div>{blocks}</div>{card}", [alone[1], *alone])):
        assert line_blocks.main_text(page) == "\n".join(parts)
    split = line_blocks.main_text(f"<div>{blocks}</div>{card}<div><p>its tail</p></div><div class=ad>no</div><footer>no</footer>")
    assert split.startswith(alone[0]) and "no" not in split.split("\n")
    long = f"<article>{blocks * 3}</article><div><p>{'thin ' * 20}</p></div>"
    assert line_blocks.main_text(long) == "\n".join(body * 3)  # what is neither denser nor longer stays outside


def test_given_pages_without_their_marks(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    plain = [re.sub("(</?)article>", r"\1div>", p) for p in pages]
    texts = [line_blocks.main_text(p) for p in pages]
    assert all(t for t in texts) and texts == [line_blocks.main_text(p) for p in plain]
    comments = ('<ol class="comment-list"><li><article><p>A long comment, of many words and more.</p></article></li>'
                '<li class="comment"><article><p>Another comment, which is as long as the first one.</p></article></li></ol>')
    for pages_now, end in ((pages, "</article>"), (plain, "</body>")):
        at = [p.rfind(end) for p in pages_now]
        assert texts == [line_blocks.main_text(p[:i] + comments + p[i:]) for p, i in zip(pages_now, at)]
    # a teaser marked in front of an unmarked body hides nothing of it where the body passes the level
    card = "<article><p>Teaser</p></article>"
    for text, page in zip(texts, plain):
        most = max(m for _, m in line_blocks._stretches([own for _, own, _ in line_blocks.lines_of(page)], 3))
        assert line_blocks.main_text(page.replace("<body>", "<body>" + card)) == ("Teaser\n" + text if most >= 86 else "Teaser")


def test_page_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in line_blocks.extract(pages.withColumns({c: F.lit(1) for c in ("text", "n_chars", "_html")})).collect()}
    for page in pages.collect():
        article = re.search("<article>(.*)</article>", page.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert got[page.page_id].text == "\n".join(b for b in blocks if b)
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>" + "long text " * 100_000)],
                                "page_id long, url string, html string")
    assert sorted(r.n_chars for r in line_blocks.extract(odd).collect()) == [0, 0, 0, 999_999]
    assert line_blocks.extract(odd.limit(0)).count() == 0


# ---- fingerprints ----


def test_entropy_of_every_window():
    rng = np.random.default_rng(0)
    for n in (10, 64, 65, 300, 2000):
        data = rng.integers(0, rng.integers(1, 200) + 1, n).astype(np.uint8)
        got = rare_features.entropies(data)
        assert len(got) == max(0, n - 63)
        for i, e in enumerate(got):
            h = -sum(c / 64 * np.log2(c / 64) for c in Counter(data[i:i + 64].tolist()).values())
            assert abs(e - h / 6 * 1000) <= 1.01


def brute_features(text, ranks):
    """Selected windows by the definition, one window at a time."""
    fine = [text[p:p + 8] for p in range(max(1, len(text) - 7))] if 0 < len(text) <= 512 else []
    chosen = []
    if len(text) >= 384:
        e = rare_features.entropies(np.frombuffer(text, np.uint8))
        r = ranks[e]
        votes = Counter()
        for start in range(len(r) - 63):
            votes[start + int(r[start:start + 64].argmin())] += 1
        chosen = [p for p in sorted(votes) if votes[p] >= 16 and e[p] >= rare_features.WEAK] or [int(r.argmin())]
    return list(dict.fromkeys(fine + [text[p:p + 64] for p in chosen]))


def test_features_and_their_independence_of_neighbours():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 97 + rng.integers(1, 26), n).astype(np.uint8)) for n in (0, 1, 7, 8, 63, 64, 128, 383, 384, 500, 512, 513, 4000, 0, 64)]
    ranks = rare_features.ranks_from(rare_features.histogram(texts))
    import xxhash

    for text, got in zip(texts, rare_features.features(texts, ranks)):
        assert got.tolist() == [xxhash.xxh64_intdigest(f) for f in brute_features(text, ranks)]
    counts = np.zeros(1001, np.int64)
    for t in texts:
        counts += np.bincount(rare_features.entropies(np.frombuffer(t, np.uint8)), minlength=1001)
    assert (counts == rare_features.histogram(texts)).all()


def test_likeness():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 900).astype(np.uint64)
    chain = rare_features.filters(hashes)
    assert chain.shape == (6, 256) and rare_features.likeness(chain, chain) == 1.0
    assert rare_features.likeness(chain, rare_features.filters(rng.integers(0, 2**63, 900).astype(np.uint64))) < 0.1
    most = rare_features.filters(np.concatenate([hashes[:640], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    assert 0.6 < rare_features.likeness(chain, most) < 0.95 and rare_features.likeness(chain, most) == rare_features.likeness(most, chain)
    empty = rare_features.filters(np.zeros(0, np.uint64))
    assert rare_features.likeness(empty, empty) == 1.0 and rare_features.likeness(empty, chain) == 0.0


def check_report(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    ranks = rare_features.ranks_from(rare_features.histogram([(t or "").encode() for _, t in rows]))

    def chain(text):
        return rare_features.filters(rare_features.features([text.encode()], ranks)[0])

    by_id = {r.doc_id: r for r in got}
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        gone = len(text) // 4
        edited = text[:len(text) - gone] + after[:gone]
        r = by_id[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == rare_features.encoded(chain(text)) and r.edited_fingerprint == rare_features.encoded(chain(edited))
        assert r.near_edited == rare_features.likeness(chain(text), chain(edited))
        assert r.near_next == rare_features.likeness(chain(text), chain(after))


def test_edit_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for stretches in (1, 3, 60):
        check_report(rows, rare_features.edit_report(docs, stretches=stretches).collect())
    check_report(rows[:1], rare_features.edit_report(docs.where(F.col("doc_id") == rows[0][0])).collect())


def test_edit_report_of_odd_rows(spark):
    rows = odd_rows()
    got = rare_features.edit_report(frame(spark, rows, clashing=True), stretches=4).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(r[0]), len(r[1] or "")) for r in rows)
    unique = [r[:2] for r in rows if r[0] not in (3, 4, None)] + [(None, "no id")]
    check_report(unique, rare_features.edit_report(frame(spark, [(*r, "en", "s", 0) for r in unique])).collect())
    assert rare_features.edit_report(frame(spark, [])).count() == 0
    prints = rare_features.fingerprints(frame(spark, rows), np.arange(1001, dtype=np.int32)).collect()
    by_text = {}
    for (_, text, *_), r in zip(rows, prints):
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint


def test_short_texts_are_near_their_edits(spark):
    words = "The quick brown fox jumps over a lazy dog while seven wizards mix boxes of liquid jade and hum old tunes by night ".split()
    rnd = np.random.default_rng(3)
    sizes = [*range(32, 142, 3), 200, 300, 383, 384, 390, 511, 512, 513, 520, 2000]
    rows = [(i, " ".join(rnd.choice(words, 400))[:n], "en", "s", 0) for i, n in enumerate(sizes)]
    got = {r.doc_id: r for r in rare_features.edit_report(frame(spark, rows, clashing=True)).collect()}
    near = [got[i].near_edited for i, *_ in rows]
    short = [x for x, n in zip(near, sizes) if n <= 141]
    assert sum(x >= 0.5 for x in short) >= 0.9 * len(short) and min(near[len(short):]) >= 0.5
    for (i, text, *_), following in zip(rows, rows[1:]):
        if len(text) < 384 and len(following[1]) < 384:
            def grams(t):
                return {t[p:p + 8] for p in range(len(t) - 7)}
            edited = text[:len(text) - len(text) // 4] + following[1][:len(text) // 4]
            a, b = grams(text), grams(edited)
            assert abs(got[i].near_edited - len(a & b) / min(len(a), len(b))) < 0.2
    # an edit that changes the bytes leaves features in common over both borders
    ranks = np.arange(1001, dtype=np.int32)
    base = " ".join(rnd.choice(words, 400)).encode()
    for n in (370, 380, 500, 510):
        a, b = (rare_features.filters(h) for h in rare_features.features([base[:n], base[:n + 20]], ranks))
        assert rare_features.likeness(a, b) >= 0.5
