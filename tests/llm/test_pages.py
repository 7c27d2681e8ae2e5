"""Operators over pages, and the pipeline."""

import base64
import hashlib
import random
from collections import defaultdict
from html.parser import HTMLParser

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from evalspark.llm import html_text, url_filter, warc
from evalspark.llm.common import scratch_path
from tests.llm.conftest import prose

PAGES = [(3, "u", "a\r\n\r\nb"), (1, None, "a\r\n\r\nb"), (2, "x\r\ny", None), (5, "v", ""), (9, "w", "é😀WARC/1.1\r\n"), (4, "é", ""), (7, "q", "x" * 200_000), (8, "q", "\u0000")]
SCHEMA = "page_id long, url string, html string"


def brute_records(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    out = {}
    for i, _, h in rows:
        data = (h or "").encode()
        again = first[h or ""] != i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
    return out


def test_warc_records_come_back(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA)
    path = scratch_path(spark, "warc-test")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(df, path).collect()}
    assert got == brute_records(PAGES)
    assert warc.read_payloads(spark, path).count() == len({h or "" for *_, h in PAGES})
    warc.export_files(spark, path, path + "-files", records_per_file=3)
    exact = sorted(bytes(r.record) for r in warc.reconstruct(spark, path).collect())
    assert exact == sorted(bytes(r.record) for r in warc.read_files(spark, path + "-files").collect())
    assert sum(b"WARC-Type: response" in r for r in exact) == len({h or "" for *_, h in PAGES}) and all(r.endswith(b"\r\n\r\n") for r in exact)


def test_warc_small_payloads_stay_responses_and_odd_rows(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (None, "u", "ab"), (None, None, None), (3, "u", "abcd")]
    df = spark.createDataFrame([(*r, "digest", 1) for r in rows], SCHEMA + ", digest string, first int")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.page_records(df, scratch_path(spark, "warc-test"), min_bytes=3).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3)]
    assert warc.page_records(df.limit(0), scratch_path(spark, "warc-test")).count() == 0


def test_warc_damaged_payload_is_noticed(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(PAGES, SCHEMA), path)
    rows = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' as binary) payload")
    rows.write.parquet(f"{path}-bad/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, path + "-bad").collect()


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("plain &lt;text&gt; only", "plain <text> only"),
    ("<article><header><h1>T</h1></header><p>a<b>b</b> c&nbsp;&amp; d<br>e<p>f<aside>x</aside><div class='share-links'>s</div></article><footer>q", "T ab c & d e f"),
    ("<div class=cookie-banner>we use</div><main><h1>A</h1><ul><li>x<li>y</ul><section id=comments><p>bad</p></section></main>after", "A x y"),
    ("<nav>a<div>b</nav>c", "c"), ("<script>var a='</p>'</script>x<!-- a --> y <style>p{}</style><form><p>no</p></form>z", "x y z"),
    ('<p title="a>b">ok</p>', "ok"), ('<p title="a>bad</p><p>x</p>', "bad x"), ("<span class=ad>no</span> yes", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<div>" * 5000 + "deep", "deep"), ("<p hidden>no<p>yes", "yes"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("a <!-- open", "a"),
    ('<div class="page no-sidebar"><article><p>Hello world</p></article></div>', "Hello world"), ('<div class="has-banner"><p>only text</p></div>', "only text"),
    ('<article><p class="ad-hoc">a</p><section id="social-history">b</section><div class="ad-slot top">no</div></article>', "a b"),
    ("<article><math><mi>x</mi></math> <label>l</label> <svg><text>s</text></svg> <object>o</object></article>", "x l s o"),
    ("<article><h1>T</h1></article><div>body</div>", "T body"), ('<div class="sidebar"><main><p>all of it</p></main></div>', "all of it"),
    ("<form id=aspnet><nav>n</nav><article>in a form</article></form>", "in a form"), ("<article><p>long enough</p><form>f</form></article>", "long enough"),
    ('<div class="sidebar"><article>teaser</article></div><article><p>the article itself, longer</p></article>', "the article itself, longer"),
    ('<body class="with-cookie-banner"><div id="Comment_List">c</div><div class="site-footer">f</div><div class="content">x</div>', "x"),
    ('<p aria-hidden="true">seen</p><p style="display: none">no</p>', "seen")])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_templates_go_and_articles_stay(spark):
    body = lambda i: f"<div><p>Welcome to this site, all of you</p></div><div><p>{prose(i, 20)}</p><p>{prose(500 + i, 15)}</p></div>"
    rows = [(i, f"http://H{i % 2}.x/{i}", f"<body>{body(i)}</body>") for i in range(40)]
    copy = "<body><div><p>copied text of an article</p><p>in two parts</p></div></body>"
    rows += [(100 + i, "http://h0.x/c", copy) for i in range(30)]
    rows += [(200 + i, "http://h1.x/a", f"<article><p>A line that many articles have</p><p>{prose(900 + i, 12)}</p></article>") for i in range(30)]
    rows += [(None, None, None), (300, None, "<p>x</p>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", text string, sig int")).collect()}
    flat = lambda *x: " ".join(" ".join(x).split())
    assert len(got) == len(rows)
    assert all(got[i][0] == flat(prose(i, 20), prose(500 + i, 15)) for i in range(40))
    assert all(got[100 + i][0] == "copied text of an article in two parts" for i in range(30))
    assert all(got[200 + i][0] == flat("A line that many articles have", prose(900 + i, 12)) for i in range(30))
    assert got[None] == ("", 0) and got[300] == ("x", 1)
    assert html_text.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_longer_than_the_articles_go(spark):
    notice = "".join(f"<p>{prose(7_000 + k, 60)}</p>" for k in range(3))
    linked = lambda i: " ".join(f"<a>{w}</a>" for w in prose(i, 25).split())
    gap = " " * 4_000
    rows = [(i, f"http://notice.x/{i}", f"<body><div>{notice}</div><div><p>{prose(i, 9)}</p><p>{linked(100 + i)}</p></div></body>") for i in range(20)]
    rows += [(50 + i, f"http://gaps.x/{i}", f"<body>{gap}<div><p>Welcome to this site</p></div>{gap}<div><p>{prose(i, 12)}</p></div>{gap}</body>") for i in range(20)]
    rows += [(100 + i, f"http://notice.x/c{i}", f"<body><nav>{prose(300 + i, 5)}</nav><div>{notice}</div><div><p>copied text</p></div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    flat = lambda *x: " ".join(" ".join(x).split())
    assert all(got[i] == flat(prose(i, 9), prose(100 + i, 25)) for i in range(20))
    assert all(got[50 + i] == flat(prose(i, 12)) for i in range(20))
    assert all(got[100 + i] == "copied text" for i in range(20))


class Tree(HTMLParser):
    """Well-formed pages as nested [tag, attributes, parts]."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#", {}, []]
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def brute_texts(pages, min_pages):
    """Templates by counting serialised subtrees per host, then what is left, block by block."""
    marked = lambda n: n[0] in ("nav", "footer", "aside") or n[1].get("class") in ("ad", "comments")

    def flat(node, gone=lambda n: False):
        return "" if gone(node) else " ".join(" ".join(p if isinstance(p, str) else flat(p, gone) for p in node[2]).split())

    def subtrees(node, main=False):
        main = main or node[0] in ("article", "main")
        for p in node[2]:
            if not isinstance(p, str):
                if flat(p) and p[0] not in ("article", "main") and (not main or p[0] in ("div", "section", "aside")):
                    yield repr([p[0], [q if isinstance(q, str) else (q[0], flat(q)) for q in p[2]]])
                yield from subtrees(p, main)

    trees = {i: (host, Tree(page).root) for i, host, page in pages}
    seen = defaultdict(set)
    for host, t in trees.values():
        for s in subtrees(t):
            seen[host, s].add(flat(t, marked))
    out = {}
    for i, (host, t) in trees.items():
        template = {s for s in subtrees(t) if len(seen[host, s]) >= min_pages}

        def gone(n, main=False, host=host, template=template):
            key = repr([n[0], [q if isinstance(q, str) else (q[0], flat(q)) for q in n[2]]])
            return marked(n) or key in template and n[0] not in ("article", "main")
        def left(n, main=False):
            main = main or n[0] in ("article", "main")
            eligible = not main or n[0] in ("div", "section", "aside")
            if n[0] != "#" and (marked(n) or eligible and gone(n)):
                return ""
            return " ".join(" ".join(p if isinstance(p, str) else left(p, main) for p in n[2]).split())
        out[i] = left(t)
    return out


def test_against_brute_force(spark):
    """Well-formed pages of three hosts: a third with marks, a third where only the counts tell, one hot host with rare blocks."""
    r = random.Random(6)
    blocks = {h: [f"<div><p>{prose(1_000 * k + j, r.randrange(3, 40))}</p></div>" for j in range(6)] for k, h in enumerate(("a.x", "b.x", "hot.x"))}
    pages = []
    for i in range(240):
        host = r.choice(["a.x", "b.x", "hot.x", "hot.x", "hot.x", "hot.x"])
        own = "".join(f"<p>{prose(50_000 + 10 * i + k, r.randrange(4, 30))}</p>" for k in range(r.randrange(1, 4)))
        around = [b for k, b in enumerate(blocks[host]) if (i % 20 == 0 if k == 4 else r.random() < (0.9 if k < 3 else 0.04))]
        if host == "a.x":
            around += [f"<nav><ul><li>{prose(90_000 + i, 3)}</li></ul></nav>", f'<div class="ad"><p>{prose(91_000 + i, 6)}</p></div>']
        pages.append((i, host, "<html><body>" + "".join(around) + f"<section><div>{own}</div></section></body></html>"))
    table = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, h, p in pages], SCHEMA)
    got = {x.page_id: x for x in html_text.extract_text(table, min_pages=5).collect()}
    want = brute_texts(pages, 5)
    assert {i: x.text for i, x in got.items()} == want
    # a block that only one page in fifty of the hot host has is template all the same
    rare = blocks["hot.x"][4]
    held = [i for i, h, p in pages if rare in p and h == "hot.x"]
    assert len(held) >= 5 and all(Tree(rare).root[2][0][2][0][2][0] not in got[i].text for i in held)
    counted = html_text.page_templates(html_text.outlines(table), 5)
    assert counted.select("key").distinct().count() > 200 and counted.where("not left").count() == 0


def test_very_long_page(spark):
    paragraphs = [prose(i, 200) for i in range(2_000)]
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"
    row = html_text.extract_text(spark.createDataFrame([(1, "http://h/1", page)], SCHEMA)).first()
    assert row.text == " ".join(" ".join(paragraphs).split()) and row.n_chars > 1_000_000


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in (*url_filter.BLOCK_RULES, *url_filter.ALLOW_RULES)
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_words(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM?x", "x://a://b/c", "http://x.NET", "http://x.net/", "http://example.net/en/x?y", "http://notexample.net/en/x",
            "http://a.example.com/de/1", "http://cas\nino.org/fr/\n/z#f", "http://É.NET/a", "http://org/fr/", "https://a.b.org/fr/x", "http://h.com/" + "a/" * 20_000]
    rows = list(enumerate(urls)) + [(100, "http://casino-bets.example.com/win"), (101, "http://cheap-pills.example.org/buy"), (102, "http://www.rivers.example.org/en/31"), (None, "http://x.net/")]
    df = spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == plain_verdict(u)
        if got[i].rule:
            assert got[i].verdict == ("block" if got[i].rule in url_filter.BLOCK_RULES else "allow")
    assert got[100].verdict == got[101].verdict == "block" and got[102].verdict == got[0].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_classifier_on_its_table(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)], "page_id long, url string")
    host, path = url_filter.host_of(df.url), url_filter.path_of(df.url)
    even = [x for i, x in enumerate(url_filter.LABELLED) if i % 2 == 0]
    scores = {r.page_id: r.s for r in df.select("page_id", url_filter.score(host, path, url_filter.train(spark, even)).alias("s")).collect()}
    held = [(scores[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(url_filter.LABELLED) if i % 2]
    assert sum(held) / len(held) > 0.8


def test_pipeline_decisions_take_effect(spark, tmp_path):
    clean = [(i, prose(10_000 + i, 120), "en", f"s{i % 3}") for i in range(60)]
    junk = [(100 + i, prose(i, 60).replace(" ", "### "), "en", "s0") for i in range(4)] + [(110, "too short", "en", "s1")]
    copies = [(200 + i, clean[i][1], "de", "s2") for i in range(5)]
    item = prose(77_777, 30)
    leaks = [(300 + i, prose(20_000 + i, 60) + "\n" + item + "\n" + prose(30_000 + i, 60), "en", "s1") for i in range(3)]
    pii = [(400, prose(40_000, 60) + " write to a.b@c.org " + prose(40_001, 60), "en", "s0")]
    rows = clean + junk + copies + leaks + pii
    random.Random(1).shuffle(rows)
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(88_888, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == {r[0] for r in clean} | {400}
    assert "[EMAIL]" in got[400].text and "a.b@c.org" not in got[400].text and got[400].n_chars == len(got[400].text)
    assert all(got[i].text == t and got[i].round_trip and got[i].n_tokens == len(got[i].token_ids) for i, t, *_ in clean)


def test_pipeline_takes_odd_rows_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    """Nulls in every column, empty and long texts, repeated rows and columns that the stages name themselves."""
    more = odd_docs.selectExpr("*", "1 AS token_ids", "'x' AS __text", "2 AS n", "true AS linked", "'k' AS component_id")
    good = spark.createDataFrame([(50 + i, prose(70_000 + i, 50), "en", "a") for i in range(6)], "doc_id long, text string, lang string, source string")
    rows = more.unionByName(good, allowMissingColumns=True)
    bench = spark.createDataFrame([(None, None), (1, ""), (2, prose(70_003, 50))], "item_id long, text string")
    d = str(tmp_path / "odd")
    rows.write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == {1, None, 5, 50, 51, 52, 54, 55} and len(got) == 8
    assert all(r.round_trip and r.n_chars == len(r.text) for r in got) and {r.score for r in got} == {1.5, None}
    empty = str(tmp_path / "empty")
    no_docs.write.parquet(f"{empty}/documents.parquet")
    bench.limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_queries_are_registered():
    names = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert sorted(int(k[2:].split("_")[0]) for k in names if k != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
