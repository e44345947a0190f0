"""The other operators: brute force, round trips, and the cases that docstrings define."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest

from sleuthframe.llm import common, exact_topk, html_text, jaccard_join, media, mixing, quality, url_filter, warc_revisits
from sleuthframe.llm.common import Scratch, components

# ---------------------------------------------------------------- Jaccard join


def sentence(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(r.randrange(40)) for _ in range(n))


def corpus():
    r = random.Random(5)
    rows = []
    for k in range(12):
        words = sentence(r, r.choice([6, 40, 120])).split()
        for c in range(r.choice([1, 2, 3, 9])):
            w = list(words)
            for _ in range(c // 2):
                w[r.randrange(len(w))] = f"changed{r.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(words).upper()))
    rows += [(500, ""), (501, None), (502, "  "), (503, "one two"), (504, "One  two"), (505, "three"), (None, rows[0][1]), (506, rows[3][1]), (507, "long " * 3000), (508, "long " * 3001)]
    return rows


def brute(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [{j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12} for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    return links, label


def test_jaccard_join(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, sig int")
    got = {r.doc_id: r for r in jaccard_join.join_documents(docs).collect()}
    links, label = brute(rows)
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        assert got[i].n_links == len(links[k]), i
        assert got[i].class_id == min(ids) and got[i].class_size == sum(1 for x in label if x == label[k])
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {min(rows[j][0] for j in range(len(rows)) if label[j] == x and rows[j][0] is not None) for x in set(label)}
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_jaccard_empty_and_repeats(spark):
    kind = "doc_id long, text string"
    assert jaccard_join.join_documents(spark.createDataFrame([], kind)).count() == 0
    twins = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "")] * 2, kind)
    assert sorted((r.doc_id, r.n_links) for r in jaccard_join.join_documents(twins).collect()) == [(1, 2)] * 3 + [(2, 0)] * 2
    assert sorted(r.doc_id for r in jaccard_join.keep_one(twins).collect()) == [1, 2, 2]


def brute_links(rows, words=5):
    """Of each (id, text) the ids of the rows that it is linked to, from sets of word tuples."""

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [(i, grams(t or "")) for i, t in rows]
    by = {}
    for k, (_, g) in enumerate(sets):
        for x in g:
            by.setdefault(x, set()).add(k)
    out = {}
    for k, (i, g) in enumerate(sets):
        near = set().union(*(by[x] for x in g)) - {k} if g else set()
        out[i] = sorted(sets[j][0] for j in near if 5 * len(g & sets[j][1]) >= 4 * len(g | sets[j][1]))
    return out


def test_jaccard_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    links = brute_links([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in jaccard_join.join_documents(docs).collect()}
    assert {i: got[i].n_links for i in got} == {i: len(x) for i, x in links.items()}
    assert all(got[i].class_id == got[j].class_id for i, x in links.items() for j in x)
    label = {i: i for i in links}
    for _ in range(len(links)):
        new = {i: min([label[i], *(label[j] for j in x)]) for i, x in links.items()}
        if new == label:
            break
        label = new
    assert {i: got[i].class_id for i in got} == label


def test_jaccard_chunks(spark):
    """A group that fills many chunks of its star gives the same links as one chunk."""
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for k in range(70):
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = brute_links(rows)
    assert sum(map(len, links.values())) > 500
    for chunk, chars in ((4, 10**6), (10**6, 2000), (512, 10**6)):
        _, nodes = jaccard_join.link_texts(docs, "doc_id", "text", 5, 0.8, 1e-8, chunk, chars)
        copies = {x.least: x for x in nodes.collect()}
        byt = {}
        for i, t in rows:
            byt.setdefault(t, []).append(i)
        assert {min(v): copies[min(v)].n_links for v in byt.values()} == {min(v): len(links[min(v)]) for v in byt.values()}


CLASH = ("score", "predicted", "topic", "tokens", "kept", "probability", "mix_source", "_key", "_md5", "_fp", "_once", "Kept_")


def test_stages_keep_other_columns(spark, tmp_path):
    """Columns named like those that the operators work with pass through the pipeline's stages."""
    import corpus_pipeline

    r = random.Random(3)
    rows = [(k, sentence(r, 40), r.choice("ab"), "en", 1, *[f"{c}{k}" for c in CLASH]) for k in range(40)]
    rows += [(40, rows[0][1], "a", "en", 1, *["z"] * len(CLASH)), (41, None, None, None, None, *[None] * len(CLASH)), (41, None, None, None, None, *[None] * len(CLASH))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    were = {tuple(x) for x in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = [tuple(x) for x in out.collect()]
        assert got and set(got) <= were
    kept = [x.doc_id for x in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept) == [*range(40), 41, 41]


def test_mix_without_words_or_targets(spark):
    kind = "doc_id long, text string, source string, lang string"
    blank = spark.createDataFrame([(1, None, "a", None), (2, "", None, "x"), (2, "  ", "a", "x")], kind)
    assert [x.kept for x in mixing.mix(blank).collect()] == [True] * 3
    words = spark.createDataFrame([(1, "a b", "a", "x"), (2, "c", "b", "x"), (3, "", "b", "x")], kind)
    assert sorted(x.doc_id for x in mixing.mix(words, targets={"source": {"none": 1.0}}).where("kept").collect()) == []
    for bad in ({}, {"a": 0.0}):
        with pytest.raises(ValueError):
            mixing.mix(words, targets={"source": bad})


def test_sample_within_characters():
    found = [(k, k % 2, 10 + k) for k in range(40)]
    one = quality.within(found, 100)
    assert all(sum(n for i, y, n in found if i in one and y == c) <= 100 for c in (0, 1)) and len(one) >= 4
    assert set(quality.within(found, 0)) == {quality.within([f for f in found if f[1] == c], 0)[0] for c in (0, 1)}
    assert sorted(quality.within(found, 10**6)) == list(range(40))


def test_bayes_bound():
    for n in (16, 64, 160):
        m = jaccard_join.fewest_matches(n, 0.8, 1e-8)
        grid = np.linspace(0, 1, 20001)[1:-1]
        like = lambda k: grid**k * (1 - grid) ** (n - k)  # noqa: B023, E731
        post = lambda k: like(k)[grid >= 0.8].sum() / like(k).sum()  # noqa: B023, E731
        assert post(m) >= 0.9e-8 and (m == 0 or post(m - 1) < 1.1e-8)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert all(got.get(x, x) == y for x, y in label.items())


# ---------------------------------------------------------------- quality


def test_quality(spark):
    r = random.Random(1)
    good = [(k, " ".join(sentence(r, 30).split()).capitalize() + ".", 1) for k in range(120)]
    bad = [(k, " ".join([r.choice("abc") + "x"] * 40), 0) for k in range(120, 200)]
    docs = spark.createDataFrame([(i, t, 0.5, "p") for i, t, _ in good + bad] + [(900, None, 0.5, "p"), (901, "", 0.5, "p"), (None, good[0][1], 0.5, "p"), (902, "word " * 50_000, 0.5, "p")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(5, None, 0), (None, 1, 0), (6, 0, 0), (700, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {x.doc_id: x for x in quality.classify(docs, model).collect()}
    held = [(i, y) for i, _, y in good + bad if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values()) and got[900].score == got[901].score and got[None].score == got[good[0][0]].score
    assert quality.classify(docs.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.classify(docs, none).collect()} == {0.5}
    one = quality.train(docs, labels.where("quality = 1"))
    assert {x.predicted for x in quality.classify(docs, one).collect()} == {1}


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="sidebar-left">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, a long notice about cookies and more cookies.</div>
%s
<aside><p>Other things of interest that are long enough to look like text of an article, yes.</p></aside><form><label>Mail</label></form>
<div id="comments"><p>A reader comment that is long enough to look like text of an article, too.</p></div><footer>&copy; x</footer></body></html>"""
ARTICLE = "<{0}><h1>A  title</h1><p>Short.</p><p>First &amp; <b>bold</b>\n text with enough words to be the surge of this page, surely.</p><p>Second with\xa0words that go on and on until they are many.<br>More<p>Third paragraph, unclosed, is as long as any other of them.</p><p>End.</p></{0}>"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"'])
def test_html_article(tag):
    body = ARTICLE.replace("</{0}>", f"</{tag.split()[0]}>").replace("<{0}>", f"<{tag}>")
    want = ["A title", "Short.", "First & bold text with enough words to be the surge of this page, surely.", "Second with words that go on and on until they are many. More", "Third paragraph, unclosed, is as long as any other of them.", "End."]
    assert html_text.main_text(PAGE % body).split("\n\n") == want


WANT = ["A title", "Short.", "First & bold text with enough words to be the surge of this page, surely.", "Second with words that go on and on until they are many. More", "Third paragraph, unclosed, is as long as any other of them.", "End."]


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="no-sidebar"', 'div class="single comments-open"', 'div id=x class="page no-ads"', 'div class="content sidebar"', 'section class="widget"', 'form id="aspnetForm"', 'div class="comments"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_wrappers_are_kept(wrapper, tag):
    if tag == "div" and wrapper.endswith('"comments"'):
        return  # readers' words beside other text are no article
    body = f"<{wrapper}>{ARTICLE.replace('{0}', tag)}</{wrapper.split()[0]}>"
    assert html_text.main_text(PAGE % body).split("\n\n") == WANT


def test_html_chapters_and_boilerplate():
    para = "<p>%s paragraph has as many words as are needed for a text of some length.</p>"
    text = lambda *names: "\n\n".join(re.sub("<[^>]*>", "", para % n) for n in names)
    page = f'<body><article>{para % "First"}<section id="discussion">{para % "Second"}</section><section id="related-work">{para % "Third"}</section><div class="related-work">{para % "Fourth"}</div>'
    junk = "".join(f'<div class="{c}">{para % "Junk"}</div>' for c in ("ad", "site-footer", "cookie-banner", "related-posts", "share-buttons", "comment-list", "left sidebar", "post__comments")) + f'<span class="share">x</span><section class="related">{para % "Junk"}</section><button class="share">Share</button>'
    assert html_text.main_text(f"{page}{junk}</article>{junk}</body>") == text("First", "Second", "Third", "Fourth")
    # Teasers and comments that are articles themselves, beside the page's article.
    teaser = f'<div class="related-posts"><article>{para % "Junk"}</article></div><ol class="comment-list"><li><article>{para % "Junk"}</article></li></ol>'
    assert html_text.main_text(f"<article>{para % 'First'}{para % 'Second'}</article>{teaser}") == text("First", "Second")
    long = f'<div id="comments">{(para % "Junk") * 9}</div>'
    assert html_text.main_text(f"<div>{para % 'First'}{para % 'Second'}</div>{long}") == text("First", "Second")
    assert html_text.main_text(f"<header>{para % 'Junk'}</header><aside>{para % 'Junk'}</aside><footer>x</footer>") == ""


def test_html_widens_beyond_parts():
    long = "Item %d has as many words as are needed for a stretch of text that is longer than others."
    items = [long % k for k in range(6)]
    wrap = {
        "ul": "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "ol": "<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>",
        "section": "<section>" + "".join(f"<p>{x}</p>" for x in items) + "</section>", "blockquote": "<blockquote>" + "".join(f"<p>{x}</p>" for x in items) + "</blockquote>",
        "table": "<table><tbody>" + "".join(f"<tr><td>{x}</td></tr>" for x in items) + "</tbody></table>",
    }
    for name, inner in wrap.items():
        page = f'<body><nav>Menu</nav><div class="content"><h1>Title</h1><p>Short.</p>{inner}<p>End.</p></div><footer>x</footer></body>'
        assert html_text.main_text(page).split("\n\n") == ["Title", "Short.", *items, "End."], name
    # A cell of a table that lays out the page is a container.
    page = f"<table><tr><td>Left</td><td><h1>Title</h1>{''.join(f'<p>{x}</p>' for x in items)}<p>End.</p></td></tr></table>"
    assert html_text.main_text(page).split("\n\n") == ["Title", *items, "End."]


PARA = "<p>%s paragraph has as many words as are needed for a text of some length.</p>"
TEXT = "%s paragraph has as many words as are needed for a text of some length."


@pytest.mark.parametrize(
    ("inner", "extra"),
    [
        ('<section id="search-algorithms">{0}{1}</section>', []), ('<div class="related-work">{0}{1}</div>', []), ('<div class="notice-of-decision">{0}{1}</div>', []),
        ('{0}<p class="share-price">The share price is up.</p>{1}', [(1, "The share price is up.")]), ('{0}<p class="form-of-verse">This form is old.</p>{1}', [(1, "This form is old.")]),
        ('{0}<p class="login-howto">Press it.</p>{1}', [(1, "Press it.")]), ("{0}<p>Press <button>OK</button> to go on.</p>{1}", [(1, "Press OK to go on.")]),
        ('<div class="post-header"><h1>The headline</h1></div>{0}{1}', [(0, "The headline")]), ("{0}<p>The <label>inline</label> word.</p>{1}", [(1, "The inline word.")]),
    ],
)
def test_html_layouts_within_articles(inner, extra):
    want = [TEXT % "A", TEXT % "B"]
    for at, text in extra:
        want.insert(at, text)
    page = f"<nav><a href=/>Menu</a></nav><article>{inner.format(PARA % 'A', PARA % 'B')}</article><footer>x</footer>"
    assert html_text.main_text(page).split("\n\n") == want


def test_html_sibling_divs():
    abc = "".join(PARA % x for x in "ABC")
    page = f'<body><nav><a href=x>Menu</a></nav><div class="page"><div class="t"><h1>Title</h1></div><div><p>Lead.</p></div><div class="b">{abc}</div><div><div><p>End.</p></div></div></div><footer>f</footer></body>'
    assert html_text.main_text(page).split("\n\n") == ["Title", "Lead.", *[TEXT % x for x in "ABC"], "End."]


def test_html_surge_and_dive_decide():
    """Lists of links that nothing marks go before the surge and after the dive, and stay between."""
    links = "<ul>" + "".join(f"<li><a href=/{k}>Place number {k} of the list</a></li>" for k in range(8)) + "</ul>"
    abc = "".join(PARA % x for x in "ABC")
    for page in (f"<div>{links}</div><div><h1>Title</h1>{abc}<p>End.</p></div><div>{links}</div>", f"<article>{links}<h1>Title</h1>{abc}<p>End.</p>{links}</article>"):
        assert html_text.main_text(page).split("\n\n") == ["Title", *[TEXT % x for x in "ABC"], "End."]
        assert len(html_text.Lines(page).texts) == 21
    page = f"<article>{abc}<p><a href=/>One line of links only</a></p>{abc}</article>"
    assert len(html_text.main_text(page).split("\n\n")) == 7


def slow_bounds(lengths, window, share):
    """Every stretch of places whose window sums reach the floor, by trial."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    floor = share * max(sums, default=0)
    runs = []
    for a in range(n):
        for b in range(a, n):
            whole = all(s >= floor and s > 0 for s in sums[a : b + 1])
            if whole and (a == 0 or not (sums[a - 1] >= floor and sums[a - 1] > 0)) and (b == n - 1 or not (sums[b + 1] >= floor and sums[b + 1] > 0)):
                last = min(n, b + window) - 1
                runs.append((-sum(lengths[a : last + 1]), a, -last))
    if not runs:
        return None
    _, a, last = min(runs)
    inner = [k for k in range(a, -last + 1) if lengths[k] >= floor / window]
    return inner[0], inner[-1]


def test_html_against_a_slow_version():
    """Random pages put together from known parts; bounds by trial; the stripped lines as the
    standard library's parser finds them."""
    from html.parser import HTMLParser

    class Slow(HTMLParser):
        def __init__(self):
            super().__init__()
            self.lines, self.off = [""], 0

        def handle_starttag(self, tag, attrs):
            if self.off or tag in ("nav", "footer", "script", "style") or ("class", "ad") in attrs:
                self.off += tag not in ("br", "a", "b", "p", "li")
            self.lines.append("") if tag in ("p", "h1", "li", "ul", "div", "article", "nav", "footer") else None
            if tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if self.off and tag not in ("br", "a", "b", "p", "li"):
                self.off -= 1
            self.lines.append("") if tag in ("p", "h1", "li", "ul", "div", "article", "nav", "footer") else None

        def handle_data(self, data):
            if not self.off:
                self.lines[-1] += data

    r = random.Random(12)
    for _ in range(150):
        paras = [sentence(r, r.choice([1, 3, 20, 60])).replace("e", r.choice(["e", "&eacute;", "<b>e</b>", "e<br>"])) for _ in range(r.randrange(1, 12))]
        paras.insert(r.randrange(len(paras) + 1), sentence(r, 60))  # else the advert is most of the page
        inner = "".join(f"<p>{p}</p>" if r.random() < 0.8 else f"<ul><li>{p}</li></ul>" for p in paras)
        tag = r.choice(["article", "div"])
        junk = f"<nav><ul><li><a href=/>Home</a></li></ul></nav><script>var x='<p>';</script><div class=\"ad\">{sentence(r, 9)}</div>"
        page = f"<html><body>{junk}<{tag}><h1>{sentence(r, 4)}</h1>{inner}</{tag}><footer>&copy; {sentence(r, 5)}</footer></body></html>"
        slow = Slow()
        slow.feed(page)
        want = [" ".join(x.split()) for x in slow.lines if x.split()]
        assert html_text.Lines(page).texts == want
        assert html_text.main_text(page).split("\n\n") == want
        sizes = [r.choice([0, 0, 3, 40, 200]) for _ in range(r.randrange(0, 14))]
        for window, share in ((3, 0.3), (1, 0.5), (5, 0.2)):
            got = html_text.bounds(sizes, window, share)
            assert got == (slow_bounds(sizes, window, share) if any(sizes) else None)


def test_html_hostile_pages_are_read_once():
    import time

    began = time.process_time()
    for part in ("<div>", "<div><p>x", '<a x="', "<a x='>", "<!--", "<table><tr><td>", "<article><form>", '<p class="ad sidebar">', "</div>", "<", "<a =", "<span class=share>x"):
        html_text.main_text(part * 100_000)
    assert time.process_time() - began < 30


def test_html_odd_pages(spark):
    for html, want in (("", ""), (None, ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<article>x</article>", "x"), ("<a href=x>only link</a>", ""), ("<script>unclosed <p>x", ""), ("<!-- open <p>x", ""), ("a < b & c", "a < b & c"), ("<p title='a>b'>q</p>", "q"), ("<p>&lt;p&gt; &amp;amp;</p>", "<p> &amp;")):
        assert html_text.main_text(html) == want, html
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("\n\n") == 19_999
    rows = spark.createDataFrame([(1, "u", None, "t"), (1, None, "<p>é</p>", "t"), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(rows).collect()) == ["", "", "é"]
    assert html_text.extract(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- URL filter, mixing, revisits: extra cases


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.com/x", "http://a.com", "https://www.example.com/en/1", "http://b.example.com/en/1", "http://WWW.Example.COM/en/?q#f", "http://x.net/es/1?a", "http://x.net/ES/1", "ftp://a.net/fr/#x", "http://" + "é" * 5000 + ".org/", "x://y://z/a", "http://notexample.com/en/", "http://a.com/x"]
    rows = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    got = {r.page_id: r for r in url_filter.filter_urls(rows).collect()}
    assert [got[k].rule for k in range(len(urls))] == [None, None, None, "com/", None, "www.example.com/en/", "example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None, "com/", "com/"]
    assert got[6].verdict == "block" and got[5].verdict == "allow" and got[12].host == "y:" and got[7].path == "/en/" and got[0].host == got[2].host == ""
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and len(got) == len(urls)
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_mix_calibrates(spark):
    r = random.Random(4)
    rows = [(k, " ".join(["notion" if r.random() < 0.5 else "going", "x"] * r.randrange(1, 30)), r.choice("aaab"), r.choice(["en", "en", "de", None]), "t", 7) for k in range(4000)]
    rows += [(None, None, None, None, "t", 7), (1, "", "a", "en", "t", 7), (1, "", "a", "en", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, tokens int")
    out = mixing.mix(docs, targets={"source": {"a": 0.5, "b": 0.5, "": 0.0, "zz": 1.0}}, temperatures={"lang": 1.0, "topic": 1.0}).collect()
    assert len(out) == len(rows)
    expect = {}
    for x in out:
        expect[x.mix_source] = expect.get(x.mix_source, 0) + x.tokens * x.probability
    assert math.isclose(expect["a"], expect["b"], rel_tol=1e-3)
    kept = {s: sum(x.tokens for x in out if x.kept and x.mix_source == s) for s in "ab"}
    assert abs(kept["a"] / kept["b"] - 1) < 0.1
    assert len({x.kept for x in out if x.doc_id == 1 and x.tokens == 0}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def tokens_kept(rows):
    return sum(x.tokens * x.probability for x in rows) / sum(x.tokens for x in rows)


def test_tiny_source_does_not_thin_the_mixture(spark):
    import corpus_pipeline as p

    rows = [(k, f"notion going word {k} " * 5, "big" if k % 3 else "small", "en" if k % 4 else "de", 1) for k in range(3000)]
    tiny = [(-1, "word " * 20, None, "en", 1)]
    columns = "doc_id long, text string, source string, lang string, n_chars long"
    with_tiny = spark.createDataFrame(rows + tiny, columns)
    kept = {x.doc_id for x in p.mix_to_targets(spark, with_tiny, "").collect()}
    assert abs(len(kept) / len(rows) - mixing.KEEP) < 0.05 and -1 in kept
    out, cells = mixing.mix_and_cells(with_tiny, keep=mixing.KEEP)
    assert math.isclose(tokens_kept(out.collect()), mixing.KEEP, rel_tol=1e-4)
    report = {(x.dim, x.value): x for x in mixing.mix_report(cells).collect()}
    assert not report["source", ""].met and report["source", ""].reached < report["source", ""].target
    assert math.isclose(report["source", "big"].reached / report["source", "small"].reached, report["source", "big"].target / report["source", "small"].target, rel_tol=1e-3)
    assert all(report["lang", v].met for v in ("en", "de"))


def test_mix_caps_and_rerakes(spark):
    # c has a tenth of the tokens and is to give a third: it is kept whole, a and b share the rest.
    rows = [(k, "word " * 10, "aaaaaabbbc"[k % 10], "en" if k % 7 else "de") for k in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    even = {"source": dict.fromkeys("abc", 1.0), "lang": {"en": 0.8, "de": 0.2}}
    out, cells = mixing.mix_and_cells(docs, targets=even, keep=0.5)
    got, expect = out.collect(), {}
    for x in got:
        expect[x.mix_source] = expect.get(x.mix_source, 0) + x.tokens * x.probability / 70_000
        expect[x.mix_lang] = expect.get(x.mix_lang, 0) + x.tokens * x.probability / 70_000
    for v, want in (("a", 0.2), ("b", 0.2), ("c", 0.1), ("en", 0.4), ("de", 0.1)):
        assert math.isclose(expect[v], want, rel_tol=1e-3), v
    assert max(x.probability for x in got) <= 1
    assert {x.value for x in mixing.mix_report(cells).collect() if x.dim == "source" and not x.met} == {"a", "b", "c"}
    # All tokens, and a value without a target.
    assert math.isclose(tokens_kept(mixing.mix(docs, keep=1.0).collect()), 1.0)
    none = mixing.mix(docs, targets={"source": {"b": 1.0}}, keep=0.5).collect()
    assert math.isclose(tokens_kept(none), 0.3, rel_tol=1e-3) and {x.mix_source for x in none if x.probability > 0} == {"b"}
    with pytest.raises(ValueError):
        mixing.mix(docs, keep=0.0)


def test_revisits(spark):
    kind = "record_id long, kind string, url string, fetched long, headers map<string,string>, digest string, length long, extra int"
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "response", "http://www.A.com/x/?utm_source=q&b=2&a=1", 10, h(etag="1", content_length="9", date="d1"), "p1", 9, 0),
        (2, "revisit", "https://a.com/x?a=1&b=2#f", 20, h(etag="1", content_length="0", date="d2"), None, None, 0),
        (3, "response", "http://a.com/x?a=1&b=2", 30, h(etag="3"), "p3", 3, 0),
        (4, "revisit", "http://a.com/x?a=1&b=2", 30, h(etag="1"), None, None, 0),
        (5, "revisit", "http://a.com/x?a=1&b=2", 40, None, None, None, 0),
        (6, "revisit", "http://other.org/", 5, h(etag="1"), None, None, 0),
        (7, "revisit", None, None, h(etag="1"), None, None, 0),
        (8, "response", None, None, h(etag="1"), "p8", 1, 0),
        (9, "revisit", "", 99, h(etag="1", last_modified="z"), None, None, 0),
        (9, "revisit", "", 99, h(etag="1", last_modified="z"), None, None, 0),
    ]
    got = {}
    for x in warc_revisits.resolve_revisits(spark.createDataFrame(rows, kind), slices=4).collect():
        got.setdefault(x.record_id, []).append(x)
    assert {k: v[0].status for k, v in got.items()} == {2: "resolved", 4: "mismatch", 5: "no_validator", 6: "no_response", 7: "no_response", 9: "no_response"}
    assert got[2][0].headers == {"etag": "1", "content-length": "9", "date": "d2"} and got[2][0].digest == "p1" and len(got[9]) == 2 and got[9][0].response_id is None
    assert warc_revisits.resolve_revisits(spark.createDataFrame([], kind)).count() == 0
    r = random.Random(3)
    many = [(k, r.choice(["response", "revisit"]), f"http://h/{r.choice('aaab')}", r.randrange(200), {"etag": r.choice("12")}, f"p{k}", k, 0) for k in range(300)]
    found = {x.record_id: x for x in warc_revisits.resolve_revisits(spark.createDataFrame(many, kind), slices=7).collect()}
    for m in many:
        if m[1] == "revisit":
            before = [x for x in many if x[1] == "response" and x[2] == m[2] and (x[3], x[0]) < (m[3], m[0])]
            last = max(before, key=lambda x: (x[3], x[0]), default=None)
            want = ("no_response", None) if last is None else ("resolved", last[0]) if last[4] == m[4] else ("mismatch", None)
            assert (found[m[0]].status, found[m[0]].response_id) == want


# ---------------------------------------------------------------- top-k


def test_top_k(spark):
    g = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in g.integers(-2, 3, 4) / 64], 0) for k in range(60)]
    rows += [(60, None, 0), (61, [1.0, None, 0.0, 0.0], 0), (62, [math.nan] * 4, 0), (63, [math.inf, 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (64, [0.5], 0), (65, [1.0, 1.0, 1.0, 1.0, 9.0], 0), (20, [0.1] * 4, 0), (66, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i, q in fine:
        if i % 20 == 0:
            want.setdefault(i, []).append(sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)[:7])
    for size in (4096, 5):
        got = {}
        for r in exact_topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, query_rows=2, block_size=size).collect():
            got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted((k + 1, *x) for tops in lists for k, x in enumerate(tops)) for i, lists in want.items()}
    assert exact_topk.top_k(df.limit(0), df).count() == 0 and exact_topk.top_k(df, df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e200, 1.0]), (1, [-1e200, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in sorted(exact_topk.top_k(big, big.where("vec_id = 0")).collect(), key=lambda r: r.rank)] == [(2, 1), (1, 2)]


def test_top_k_broadcasts_no_block(spark):
    """Blocks look small to the planner, as their files are compressed and read before each is sent to all others."""
    df = spark.range(300).selectExpr("id AS vec_id", "array(1D, id / 300D) AS embedding")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = exact_topk.top_k(df, df.where("vec_id % 20 = 0"), k=3, query_rows=4, block_size=32)
        assert got.count() == 45
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 2


# ---------------------------------------------------------------- media


def test_media(spark):
    texts = [(1, "x"), (2, None), (3, ""), (None, "n"), (4, "é" * 70_000), (1, "x"), (5, "a" * 64), (6, "tail\0")]
    folder = Scratch(spark, "test").root
    docs = spark.createDataFrame([(i, t, b"q") for i, t in texts], "doc_id long, text string, payload binary")
    media.write_archives(docs, folder)
    rows = media.read_archives(spark, folder, rangeBytes=100).collect()
    want = sorted((("null" if i is None else str(i)), (t or "").encode()) for i, t in texts)
    got = sorted((r.member.split("_")[1][:-4], bytes(r.payload)[: r.n_bytes]) for r in rows)
    assert got == want and all(r.error is None and len(r.payload) % 64 == 0 and not any(r.payload[r.n_bytes :]) for r in rows)
    assert len({hashlib.sha256(r.media).hexdigest() for r in rows if bytes(r.payload[: r.n_bytes]) == b"x"}) == 1
    empty = Scratch(spark, "test").root
    media.write_archives(docs.limit(0), empty)
    assert media.read_archives(spark, empty).count() == 0


def test_member_is_retried_alone(tmp_path):
    import zipfile

    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k}", media.encode_png(b"data%d" % k))
    where = fs.LocalFileSystem()
    good = where.open_input_file(str(tmp_path / "a.zip"))

    class Flaky:
        calls = 0

        def read_at(self, n, at):
            Flaky.calls += 1
            if Flaky.calls < 3:
                raise OSError("lost")
            return good.read_at(n, at)

    info = zipfile.ZipFile(tmp_path / "a.zip").infolist()
    data, error = media.read_member(Flaky(), info[1], 2, Flaky)
    assert error is None and media.decode_png(data)[0][:5] == b"data1"
    info[2].CRC ^= 1
    assert media.read_member(good, info[2], 1)[0] is None and media.read_member(good, info[0])[1] is None


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(8)
    rows = [(k, sentence(r, 60).capitalize() + ".", "en", r.choice("ab"), 1) for k in range(60)]
    rows += [(k, "junk " * 30, "en", "a", 1) for k in range(60, 90)] + [(k, rows[k % 5][1], "en", "b", 1) for k in range(90, 99)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in p.STAGES[:3]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {x.doc_id for x in now.collect()}
        if name == "quality":
            assert not ids & set(range(60, 90)) and ids >= set(range(60))
        if name == "near_duplicates":
            assert not ids & set(range(90, 99)) and ids >= set(range(60))
    pieces = p.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == ids
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert json.dumps([k for k, _ in p.STAGES])


def test_media_query_columns(spark):
    """Every digest of the query against a recomputation from the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in media.op9_media_columns(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    same = {}
    for d in docs:
        raw = (d.text or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert same.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_quality_scores_one_by_one():
    """Scores of a batch against each text's own dot product."""
    r = random.Random(6)
    texts = [sentence(r, r.randrange(1, 60)) for _ in range(60)] + ["", "a", "a a a a", "ÄÖ! x?? 12"]
    rows = [quality.indicators(t) for t in texts]
    model = quality.fit(rows[:60], np.array([k % 2 for k in range(60)]))
    slope, shift = model["curve"]
    for got, row in zip(quality.scores(texts, model), rows, strict=True):
        weighted = dict(zip(row.tolist(), quality.scaled(row, model["scale"]).tolist(), strict=True))
        margin = sum(float(model["weights"][f]) * v for f, v in weighted.items()) + model["bias"]
        assert got == pytest.approx(1 / (1 + math.exp(-(slope * margin + shift))), rel=1e-5)
    assert len(quality.scores([], model)) == 0
