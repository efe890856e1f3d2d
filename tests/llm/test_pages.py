"""Page text: wrappers of hosts, odd pages, and pages whose text is known from how they were made."""

import html as markup

import numpy as np
import pytest

from chunkwright.llm import html_wrappers
from chunkwright.llm.html_wrappers import KIDS, OPTIONAL, REPEATED

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, rows, **how):
    got = html_wrappers.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"]: r["text"] for r in got}


def wrapper(pages):
    whole = None
    for page in pages:
        new = html_wrappers.tree(page)
        whole = new if whole is None else html_wrappers.unite(whole, new)
    return html_wrappers.parse(html_wrappers.dump(whole))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<{tag}><h1>Head {k}</h1><p>First&amp;  one &lt;{k}&gt; <b>bold</b><br>next<p>Second &#233; {k}</p><!-- <p>gone</p> --><aside>side</aside><form><p>mail</p></form></{close}>
<div class="sidebar"><p>other</p></div><div id="comments"><p>first! {k}</p></div><footer><p>foot</p></footer></body></html>"""


def test_pages(spark):
    def want(k):
        return f"Head {k}\n\nFirst& one <{k}> bold next\n\nSecond é {k}"

    rows = [(k, f"http://a.example/{k}", PAGE.format(tag="article", close="article", k=k)) for k in range(4)]
    rows += [(10 + k, f"http://b.example/{k}", PAGE.format(tag='div class="x1"', close="div", k=10 + k)) for k in range(4)]
    rows += [(90, None, None), (91, "http://c", ""), (92, "http://c", "just text"), (93, "http://c", "<p>a<p>b & c &nosuch; < d<li>e"), (94, "http://a.example/0", PAGE.format(tag="article", close="article", k=94)), (94, "http://a.example/0", PAGE.format(tag="article", close="article", k=94))]
    rows.append((95, "http://d/", '<div class="page has-sidebar"><article><p>kept</p></article><div class="sidebar">x</div></div>'))
    rows.append((96, "http://d/1", '<article><p>own</p></article><div id="comments"><article><p>reader</p></article></div>'))
    got = html_wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    for k in [*range(4), *range(10, 14), 94]:
        assert text[k] == want(k), k
    assert text[95] == "kept" and text[96] == "own"
    assert text[90] == text[91] == "" and text[92] == "just text" and text[93] == "a\n\nb & c &nosuch; < d\n\ne"


def test_wrapper_shapes():
    both = wrapper(["<div><h1>x</h1><p>1</p><p>2</p></div>", "<div><h1>y</h1><hr><p>3</p></div>"])
    assert [(k[0], k[OPTIONAL], k[REPEATED]) for k in both[KIDS][0][KIDS]] == [("h1", False, False), ("hr", True, False), ("p", False, True)]
    told = ["", {"html": ["root", {"div.x": ["drop", {}], "p": ["", {"b": ["constant", {}]}]}]}]
    assert html_wrappers.parse_decision(html_wrappers.dump_decision(told)) == told and html_wrappers.parse_decision(None) is None


def test_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        pairs = html_wrappers._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert html_wrappers._common(list("pup"), list("up")) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("copies", [False, True])
def test_long_common_openings_and_copies_are_no_template(spark, copies):
    """Texts that open with the same 200 characters, and full copies of one page, aren't constant texts of a host."""
    opening = "the same words at the start of each page " * 8
    said = [opening + ("and one end" if copies else f"and end number {i} of its own") for i in range(4)]
    rows = [(i, f"http://h.example/{i}", f"<html><body><div><p>{t}</p></div></body></html>") for i, t in enumerate(said)]
    assert texts(spark, rows) == {i: " ".join(t.split()) for i, t in enumerate(said)}


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": -1}])
def test_the_wrapper_decides_inside_articles(spark, how):
    """A constant element inside articles goes, which no page tells alone; the same on two pages, or in copies of one article, stays."""
    page = lambda host, k, story: (k, f"http://{host}/{k}", f'<body><p>top {k}</p><article><h2>Report</h2><p>{story}</p><div class="strap">Written for you by the {host} desk</div><p>end of {story}</p></article></body>')
    rows = [page("many", k, f"story {k}") for k in range(5)] + [page("few", 10 + k, f"story {k}") for k in range(2)] + [page("same", 20 + k, "one story") for k in range(5)]
    got = texts(spark, rows, **how)
    for k in range(5):
        assert got[k] == f"Report\n\nstory {k}\n\nend of story {k}"
        assert got[20 + k] == "Report\n\none story\n\nWritten for you by the same desk\n\nend of one story"
    assert got[10] == "Report\n\nstory 0\n\nWritten for you by the few desk\n\nend of story 0"
    assert html_wrappers.extract(rows[0][2], None) != got[0]


def test_extreme_pages(spark):
    """Deep nesting, very many different children, long names that differ late, and a very long text."""
    deep = lambda k: "<div>" * 5000 + f"<p>deep {k}</p>" + "</div>" * 5000
    name = lambda i, k: "".join(chr(97 + i // 26**e % 26) for e in range(4)) + k
    wide = lambda k: "".join(f"<div class='{name(i, k)}'>t{i}</div>" for i in range(30000))
    long = "word " * 400_000
    rows = [(k, "http://deep/", deep(k)) for k in range(3)] + [(10 + k, "http://wide/", wide("xyz"[k])) for k in range(3)]
    rows += [(20 + k, "http://long/", f"<article><div class='{'n' * 80}a'><p>{k} {long}</p></div><div class='{'n' * 80}b'>always this</div></article>") for k in range(3)]
    got = texts(spark, rows)
    for k in range(3):
        assert got[k] == f"deep {k}"
        assert got[10 + k] == "\n\n".join(f"t{i}" for i in range(30000))
        assert got[20 + k] == f"{k} {long}".strip()
    assert html_wrappers.signature("p", f' class="{"n" * 80}a"') != html_wrappers.signature("p", f' class="{"n" * 80}b"')


def test_more_children_than_kept_apart_lose_no_text(spark):
    """A host whose pages have hundreds of element names: those beyond WIDEST are one group, whose text stays."""
    names = ["".join(chr(97 + i // 26**e % 26) for e in range(3)) + "q" for i in range(300)]
    pages = ["<body>" + "".join(f"<div class='{n}'>{n} {k} {'x' * (i % 7)}</div>" for i, n in enumerate(names) if (i + k) % 3) + "</body>" for k in range(6)]
    whole = wrapper(pages)
    assert len(whole[KIDS][0][KIDS]) == html_wrappers.WIDEST and whole[KIDS][0][KIDS][-1][0] == html_wrappers.ANY
    got = texts(spark, [(k, "http://w/", p) for k, p in enumerate(pages)])
    for k, page in enumerate(pages):
        assert got[k] == html_wrappers.extract(page, None) and got[k].count("\n\n") == 199


def test_decisions_speak_of_children_beyond_the_widest():
    """Constant elements, link lists and the content element among hundreds of names are found as among few."""
    name = lambda i: "x" + "".join(chr(97 + i // 26**e % 26) for e in range(3))
    strange = lambda k: "".join(f"<div class='{name(300 * k + i)}'>{k} {i}</div>" for i in range(300))
    strap = "<section class='strap'>Written by the desk</section><section class='more'><a href='/'>one more</a></section>"
    story = lambda k: f"<section class='story'><p>{'own words ' * 900} {k}</p></section>"
    article = [f"<article>{strange(k)}{strap}</article>" for k in range(4)]
    got = html_wrappers.decide(wrapper(article))
    assert got[1]["article"][1] == {"section.strap": ["constant", {}]}
    plain = [f"<body>{strange(k)}{strap}{story(k)}</body>" for k in range(4)]
    for pages in (plain, plain[::-1]):
        got = html_wrappers.decide(wrapper(pages))
        assert got[1]["body"][1]["section.story"][0] == "root"
        assert html_wrappers.extract(plain[1], got) == " ".join(f"{'own words ' * 900} 1".split())
    halves = [wrapper(plain[:2]), wrapper(plain[2:])]
    assert html_wrappers.decide(html_wrappers.parse(html_wrappers.dump(html_wrappers.unite(*halves)))) == html_wrappers.decide(wrapper(plain))
    assert len({k[0] for k in html_wrappers._children(wrapper(plain)[KIDS][0])}) == 4 * 300 + 3


def test_empty_table_and_other_columns(spark):
    assert html_wrappers.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "http://a/", "<p>x</p>", "h", "d", 7, "t"), (1, "http://a/", "<p>x</p>", "h", "d", 7, "t"), (None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA + ", host string, decision string, salt int, text string")
    got = html_wrappers.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "http://a/", "x", 1), (1, "http://a/", "x", 1), (None, None, "", 0)]


@pytest.mark.parametrize("main", [True, False])
def test_made_pages(spark, main):
    """Pages made from known blocks: what is extracted is what was put in, whatever markup stands in and around it."""
    rng = np.random.default_rng(8)
    words = "alpha beta gamma δέλτα épsilon zeta&eta <theta> \"iota\" kappa lambda mu 1 22 333".split()
    phrase = lambda low, high: [str(w) for w in rng.choice(words, rng.integers(low, high))]
    rows, want = [], {}
    for k in range(40):
        host, parts, said = f"h{k % 4}", [], []
        for _ in range(rng.integers(3, 9)):
            own = phrase(4, 30)
            said.append(" ".join(own))
            spaced = "".join(markup.escape(w) + str(rng.choice([" ", "\n", "\t ", " <b></b>", "<!-- x --> ", "<br>"])) for w in own)
            parts.append(str(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>", "<div>{}</div>", "<p><em>{}</em>"])).replace("{}", spaced))
            if rng.random() < 0.4:
                parts.append(str(rng.choice(["<script>var a = '<p>no</p>';</script>", "<style>p {}</style>", "<aside>no</aside>", "<form><p>no</p></form>", "<div class='advert'>no</div>", "<p class='cookie-notice'>no</p>"])))
        holder = "article" if main else "div class='body'"
        links = "".join(f"<li><a href='/{w}'>{markup.escape(w)}</a>" for w in phrase(2, 8))
        rows.append((k, f"https://{host}.example/{k}", f"<!doctype html><html><head><title>no</title></head><body><nav><ul>{links}</ul></nav><div class='sidebar'>{k} no</div><{holder}>{''.join(parts)}</{holder.split()[0]}><section class='comments'><p>no {k}</p></section><footer>{k} no</footer></body></html>"))
        want[k] = "\n\n".join(said)
    assert texts(spark, rows) == want


def test_marks_as_one_pattern_has_them():
    import random
    import re

    # Fixed value: what a comment, a tag and a declaration are, as one pattern.
    stated = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
    rng = random.Random(1)
    bits = ["<", ">", "a", "/", " ", '"', "'", "<!--", "-->", "!", "?", "\n", "<p>", "</p>", "=", '<a b="c">', "<div class='q'>", "<br/>", "--"]
    for _ in range(20_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 22)))
        want, at, got, to = [], 0, [], 0
        while at < len(page) and (m := stated.search(page, at)):
            want.append((m.start(), m.end(), m[1] or "", m[2] or "", m[3] or ""))
            at = m.end()
        marks = html_wrappers.Marks(page)
        while to < len(page) and (m := marks.find(to)):
            got.append(m)
            to = m[1]
        assert got == want, page


def test_broken_markup_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    for page in ("<a b " * 200_000, '<a "' * 250_000, "<a <a " * 80_000 + '"' + "x" * 100_000 + ">", "<!a " * 250_000, "<script>" + "</script " * 100_000, "<!--" * 250_000, "<a'a'" * 150_000 + ">", "<a'" * 150_000 + ' " >'):
        for _ in html_wrappers.events(page):
            pass
    assert time.perf_counter() - began < 30
