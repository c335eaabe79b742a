"""Page operators against hand-made pages and brute force."""
import random
import time

import pytest

from lureframe.llm import html_text as ht, url_reputation as ur

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">A</a><li>B</ul></nav>
<div class="ad">Buy &lt;now&gt;</div><article><h1>{title}</h1>{body}<div class="share-bar">Share</div></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><form><label>Mail</label><input></form>
<aside><p>Related</p></aside><footer>&copy; 2024</footer></body></html>"""


def text_of(page):
    """A page without a neighbour: mark-up alone decides."""
    return "\n".join(ht.text_lines(ht.lines_of(page), None)[0])


def test_declared_article():
    body = "<p>one<p>two <b>bold</b>\n word<br>x &amp; y&#33; &eacute;</p><ul><li>a<li>b</ul><blockquote>q</blockquote><pre>k  k</pre>"
    assert text_of(PAGE.format(title="A &quot;title&quot;", body=body)) == 'A "title"\none\ntwo bold word x & y! é\na\nb\nq\nk k'


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain", "plain"), ("a < b & c", "a < b & c"), ("<p>a<!-- x > y --><p>b<!-- open", "a\nb"), ("<p>a<script>x", "a"),
    ("<div class=ad><p>buy</div><p>text", "text"), ("<p class='ad'>buy<p>text", "text"), ("<article><header><h1>H</h1></header><p>t</article>", "H\nt"),
    ("<nav>m<article><p>t</article>", "t"), ("<p title='a>b'>t", "t"), ("<P>A<BR/>B</P><P>C", "A B\nC"), ("<td>a</td><td>b</td>", "a\nb"),
    ("<div class='post-header'>h</div><p>t", "h\nt"), ("<p>a&nbsp; b&#x41;&am;&ampx", "a bA&am;&x"), ("<div hidden class=\"x", "<div hidden class=\"x"),
    ("<span class='advert'>no</span>yes", "yes"), ("</p></div>x</article>", "x"),
])
def test_odd_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "a", "<p><b>x" * 50_000, "<a href=\"x" * 50_000, "<a href=\"x" * 50_001 + ">y", "<" * 200_000, "<!--" * 50_000,
                                  "<i>" * 50_000 + "<p>a" * 2_000, "</x>" * 50_000, "<a b='" * 50_000 + ">"])
def test_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    ht.lines_of(page)
    assert time.perf_counter() - began < 10


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(3)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = (r.sample(range(30), r.randint(0, 20)) for _ in range(2))
        places = ht.common_lines(a, b)
        assert places == sorted(set(places)) and len(places) == length(a, b)
        at = [b.index(a[i]) for i in places]
        assert at == sorted(at)


def test_extract_text(spark):
    def bare(k, lines):  # no landmark: only the neighbours tell the template
        return "<div>Welcome to our site</div><div>Top stories today</div>" + "".join(f"<div>{x}</div>" for x in lines) + "<div>All rights kept</div>"

    own = {k: [f"story {k} line {i} with words of its own" for i in range(4)] for k in range(40)}
    rows = [(k, f"http://H.example.com/news/{k:03d}?x={k}", bare(k, own[k]), "clash", k) for k in range(40)]
    rows += [(100, "http://h.example.com/news/007", rows[7][2], "copy", 0),       # a copy beside its original deletes nothing
             (101, "http://lone.example.org/a", bare(1, ["only"]), "", 0), (102, None, None, "", 0), (103, "no-url", "", "", 0),
             (None, "http://x.example/", "<p>x", "", 0), (104, "http://q.example/", PAGE.format(title="t", body="<p>shared quotation</p>"), "", 0),
             (105, "http://q.example/z", PAGE.format(title="u", body="<p>shared quotation</p>"), "", 0), (105, "http://q.example/z", PAGE.format(title="u", body="<p>shared quotation</p>"), "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, k1 string, host long").repartition(3)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = ht.extract_text(pages).collect()
        got = {r["page_id"]: r for r in out}
        assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
        for k in range(40):
            assert got[k]["text"] == "\n".join(own[k]) and got[k]["n_template"] == 3, k
        assert got[100]["text"] == "\n".join(own[7])
        assert got[101]["text"] == "Welcome to our site\nTop stories today\nonly\nAll rights kept"
        assert got[102]["text"] == got[103]["text"] == "" and got[None]["text"] == "x"
        assert got[104]["text"] == "t\nshared quotation" and got[105]["text"] == "u\nshared quotation"
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ht.extract_text(pages.limit(0)).count() == 0


def test_alignment_decides_what_goes(spark):
    long = lambda k: f"Chapter {k} tells at some length what has been tried before, by whom, with which results, and why none of it was enough to end the story."
    teaser = lambda k: f"<div class='menu'><a>Home</a></div><article><p>Teaser</p></article><div><p>Story {k} begins.</p><p>{long(k)}</p></div><div>Imprint</div>"
    section = lambda k: f"<h1>Paper {k}</h1><section id='related-work'><p>{long(k)}</p><p>{long(k + 100)}</p></section>"
    short = lambda k: "".join(f"<div>Template line {i} of the site</div>" for i in range(20)) + f"<div>Story {k} is short, yet longer than a twentieth of the page.</div>"
    lists = lambda k: "<div class=sidebar>" + "".join(f"<p>entry {k} {i}</p>" for i in range(3 + k % 3)) + f"</div><article><p>{long(k)}</p></article>"
    rows = [(k, f"http://a.example/{k:02d}", teaser(k)) for k in range(10)] + [(20, "http://lone.example/x", section(20))]
    rows += [(30 + k, f"http://c.example/{k:02d}", section(30 + k) if k == 4 else f"<h1>Paper {30 + k}</h1><p>{long(30 + k)}</p>") for k in range(9)]
    rows += [(40 + k, f"http://d.example/{k:02d}", short(40 + k)) for k in range(8)] + [(50 + k, f"http://d.example/03c{k}", short(43)) for k in range(4)]
    rows += [(60 + k, f"http://e.example/{k:02d}", lists(60 + k)) for k in range(8)]
    out = {r["page_id"]: r for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(10):
        assert out[k]["text"] == f"Story {k} begins.\n{long(k)}" and out[k]["n_template"] == 3, out[k]
    for k in (20, 34):                                       # alone, or alone in having such a section
        assert out[k]["text"] == f"Paper {k}\n{long(k)}\n{long(k + 100)}"
    for k in [*range(40, 48), *range(50, 54)]:               # most of the page is template; copies look past each other
        assert out[k]["text"] == f"Story {43 if k >= 50 else k} is short, yet longer than a twentieth of the page." and out[k]["n_template"] == 20, out[k]
    for k in range(60, 68):                                  # the element goes as a whole, though its lines differ in number and wording
        assert out[k]["text"] == long(k) and out[k]["n_markup"] == 0


def test_first_and_last_page_of_a_range_are_no_neighbours(spark):
    page = lambda k, more: "".join(f"<div>{x}</div>" for x in [*more, *(f"story {k} line {i} with words of its own" for i in range(4))])
    rows = [(k, f"http://h.example/{k}", page(k, ["far"] if k in (0, 4) else [])) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in ("1", "3", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r["n_template"] for r in ht.extract_text(pages).collect()} == {0}, parts
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# -- 8 ---------------------------------------------------------------------------------------------------------------------

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in host), path


def test_urls_and_rules(spark):
    urls = [None, "", "no", "http://", "http://A.Example.NET/en/x", "https://example.net/en", "http://a.net", "http://a.net/", "x://b.example.com/de/1?y#z",
            "http://notexample.com/de/1", "http://a.org/fr/", "http://a.org/FR/", "http://h?/en/", "http://h#://b/c", "http://u:p@h.net:80/x", "a://b://c/d", "http://Ä.org/fr/\n"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in ur.judge_urls(pages, none, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts_of(u)
        fits = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u


def test_reputation_shrinks(spark):
    r = random.Random(1)
    rows, told = [], []
    for h in range(60):
        rate = 0.9 if h < 6 else 0.05
        for k in range(40 if h % 3 else 2):
            rows.append((len(rows), f"http://h{h}.site{h % 4}.example/{k}"))
            told.append((rows[-1][0], int(r.random() < rate)))
    told += [(0, None), (999_999, 1), (1, 1), (1, 1)]  # no outcome, no page, two outcomes of one page
    rows += [(len(rows), "http://fresh.site1.example/"), (None, None)]
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(told, "page_id long, bad int")
    got = {x["host"]: x for x in ur.reputation(ur.host_outcomes(pages, outcomes)).collect()}
    assert got["fresh.site1.example"]["n"] == 0 and 0 < got["fresh.site1.example"]["posterior_mean"] < 0.5
    for host, x in got.items():
        assert 0 < x["posterior_mean"] < 1 and x["posterior_low"] < x["posterior_mean"]
    judged = {x["host"]: x["verdict"] for x in ur.judge_urls(pages, outcomes, ()).collect()}
    assert {h for h, v in judged.items() if v == "block"} >= {f"h{h}.site{h % 4}.example" for h in (1, 2, 4, 5)}
    assert all(judged[f"h{h}.site{h % 4}.example"] == "allow" for h in range(6, 60)) and judged["fresh.site1.example"] == "allow"
    assert ur.judge_urls(pages.limit(0), outcomes, RULES).count() == 0
    with pytest.raises(ValueError):
        ur.judge_urls(pages, outcomes, [("a/", "block")] * (ur.MAX_RULES + 1))
