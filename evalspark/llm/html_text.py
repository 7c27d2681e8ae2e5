"""Main text of HTML pages by removing the site's template.

1. Every page is parsed into block elements; each block subtree, marked or not, gets a hash of its tags and text.
2. Spark counts, per host, on how many different pages a subtree occurs. Copies of one page, equal in
   all text that is not marked, are one page. A subtree on at least MIN_PAGES pages of its host is template.
3. Template subtrees go. What no count can tell, since its text differs from page to page, goes by its marks: a tag,
   role, class or id that says menu, header, footer, sidebar, notice, advert, form, script, style or comments.

Paragraphs, headings, lists and tables of the article itself are never template, however often a
site repeats them: inside ``article`` or ``main`` only plain containers are counted. A page that has
neither is counted whole. A class or id marks an element only if all parts of one of its words speak of such a thing
(``cookie-banner``, not ``no-sidebar`` or ``ad-hoc``), and never an element that holds all the page has of ``article`` and ``main``.

Parsing runs in Python over Arrow batches, one page at a time. The counts, the choice of templates
and the way back from a template to the pages that hold it are Spark aggregates and joins: no list of
templates is broadcast or kept per host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .url_filter import host_of

#: Different pages of a host that a template occurs on, whatever the size of the host.
MIN_PAGES = 5
#: An article or main element is the main text if it has this share of what is left of the page.
_MAIN_SHARE = 0.25

_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are no article: menus, footers, sidebars, notices, forms and their controls, scripts, styles, what is never shown.
_DROP = frozenset("""nav menu footer aside dialog form fieldset button select textarea datalist search script style noscript template
iframe noembed noframes head title""".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark an element, words that may stand beside them, and words that mark a header outside the article.
_DROP_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb
breadcrumbs footer sitefooter comments comment respond disqus replies share sharing related login search masthead topbar pagination pager skip""".split())
_BESIDE = frozenset("""site page main global top bottom left right primary secondary upper lower inner outer box bar list item items wrapper wrap container
block area section form slot unit widget widgets link links panel content text body head title social buttons icons posts thread reader readers user users
google dfp sticky fixed mobile desktop small large""".split())
_HEADER_WORDS = frozenset("header siteheader pageheader".split())
#: Elements that are never dropped for their class or id.
_KEEP = frozenset("html body main article".split())
#: What a new element closes if it is open directly around it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_UNSHOWN = frozenset("head template noscript".split())
#: Inside the article only these are counted as template.
_CONTAINERS = frozenset("div section aside details figure fieldset form".split())

_TAG = re.compile(r"""<(?:/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)
|([a-zA-Z][^\s/>]*)(?:>|((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*)(?:>|\Z))
|!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z))""", re.S | re.X)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")
_MAIN = re.compile(r"""<(?:article|main)(?=[\s/>])|<[a-z][^<>]*\srole\s*=\s*["']?main(?=["'\s/>])""", re.I)
#: Attributes without any of these cannot mark an element.
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)


class _Node:
    __slots__ = ("tag", "parts", "main", "eligible", "gone", "hash", "text")

    def __init__(self, tag: str, main: bool = False, eligible: bool = False, gone: bool = False):
        self.tag, self.main, self.eligible, self.gone = tag, main, eligible, gone
        self.parts, self.hash, self.text = [], 0, False


def _says(value: str, in_main: bool) -> bool:
    """Whether a word of a class or id marks an element: one of its parts does, and all others may stand beside it."""
    for word in value.split():
        parts = set(_WORDS.findall(word))
        marks = parts & _DROP_WORDS or (not in_main and parts & _HEADER_WORDS)
        if marks and parts <= _DROP_WORDS | _BESIDE | _HEADER_WORDS:
            return True
    return False


def _marked(tag: str, attrs: str, in_main: bool) -> str:
    """Why an element is dropped for what it is: ``tag``, ``name`` (role, class, id), ``hidden``, or nothing."""
    if tag in _DROP or (tag == "header" and not in_main):
        return "tag"
    if not attrs or tag in _KEEP or not _TELLING.search(attrs):
        return ""
    low = attrs.lower()
    if "hidden" in low and re.search(r"(?:^|\s)hidden(?:[\s=]|$)", low):
        return "hidden"
    for name, a, b, c in _ATTR.findall(low):
        value = a or b or c
        if name == "role" and value.strip() in _DROP_ROLES:
            return "name"
        if name in ("class", "id") and _says(value, in_main):
            return "name"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
    return ""


def _skip(page: str, tag: str, at: int) -> int:
    """Behind the end of a dropped inline element that began before ``at``; the page's end if it has none."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(page)


def _holds_all(page: str, tag: str, at: int, mains: list[int]) -> bool:
    """Whether the element that began before ``at`` holds all article and main elements of the page, of which there are some."""
    return bool(mains) and mains[0] >= at and mains[-1] < _skip(page, tag, at)


def parse(page: str, templates: Collection[int] = (), marks: bool = True) -> tuple[_Node, list[tuple[int, bool]], int]:
    """The root of the block elements, (hash, still there) of the subtrees that may be template, a signature of the content.

    Elements that are dropped for what they are, and subtrees whose hash is in ``templates``, are
    marked as gone. The signature is the hash of all the text that is not dropped, white space aside:
    copies of a page have one signature whatever marked elements are around them. Unclosed and stray
    tags are repaired as a browser does in the common cases; unclosed inline elements do not matter. Without
    ``marks`` only what is never shown goes, and templates.
    """
    mains = [m.start() for m in _MAIN.finditer(page)]
    root = _Node("#")
    stack, seen, at, n_main, n_gone, sig = [root], [], 0, 0, 0, xxhash.xxh64(seed=2)

    def close(upto: int) -> None:
        nonlocal n_main, n_gone
        while len(stack) > upto:
            node = stack.pop()
            n_main -= node.main
            n_gone -= node.gone
            body = f"{node.tag}|" + " ".join([" ".join(p.split()) if isinstance(p, str) else f"<{p.hash:x}>" for p in node.parts])
            node.hash = xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass"), 1)
            node.text = any([p.text if isinstance(p, _Node) else not p.isspace() for p in node.parts])
            if node.text and node.eligible:
                seen.append((node.hash, not (node.gone or n_gone)))
                node.gone = node.gone or node.hash in templates
            stack[-1].parts.append(node)

    while True:
        m = _TAG.search(page, at)
        run = page[at:m.start() if m else len(page)]
        if run:
            run = entities.unescape(run) if "&" in run else run
            stack[-1].parts.append(run)
            if not n_gone:
                sig.update("".join([w + " " for w in run.split()]).encode("utf-8", "surrogatepass"))
        if not m:
            break
        at = m.end()
        end, tag, quoted, loose = m.groups()
        attrs = quoted or loose or ""
        if end:
            end = end.lower()
            if end in _BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == end:
                        close(i)
                        break
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                stack[-1].parts.append(" ")
            continue
        why = _marked(tag, attrs, n_main > 0) if marks or tag in _UNSHOWN else ""
        # wrappers of the whole article are no template, whatever they are called
        gone = bool(why) and not ((why == "name" or tag == "form") and not n_main and not n_gone and _holds_all(page, tag, at, mains))
        if tag not in _BLOCK:
            if gone and tag != "head" and not attrs.endswith("/"):
                at = _skip(page, tag, at)
            continue
        while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in _CLOSES.get(tag, ())):
            close(len(stack) - 1)
        main = tag in ("main", "article") or ("role" in attrs and "main" in [v for a in _ATTR.findall(attrs) if a[0] == "role" for v in a[1:]])
        node = _Node(tag, main, not main and (n_main == 0 or tag in _CONTAINERS), gone)
        n_main += main
        n_gone += gone
        stack.append(node)
    close(1)
    return root, seen, sig.intdigest()


def _text(node: _Node, take: bool) -> str:
    """Text of what is left of a subtree, block by block; unless ``take``, of its outermost article or main elements only."""
    out, todo = [], [(node, take)]
    while todo:
        part, inside = todo.pop()
        if isinstance(part, str):
            if inside:
                out.append(part)
        elif part.gone:
            out.append(" ")
        else:
            inside = inside or part.main
            out.append(" ")
            todo.append((" ", True))
            todo.extend((p, inside) for p in reversed(part.parts))
    return " ".join("".join(out).split())


def main_text(page: str | None, templates: Collection[int] = (), marks: bool = True) -> str:
    """The article of a page: its ``article`` and ``main`` elements if they have most of what is left, else all of that. Empty if there is none."""
    return _article(parse(page or "", templates, marks)[0])


def _article(root: _Node) -> str:
    whole, main = _text(root, True), _text(root, False)
    return main if main and len(main) >= _MAIN_SHARE * len(whole) else whole


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds sig, hashes, whether each of them is left by the marks, and the text to page_id, url, key, host, html."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        sigs, hashes, there, texts = [], [], [], []
        for page in batch.column(4):
            root, seen, sig = parse(page.as_py())
            sigs.append(_signed(sig))
            left = {}
            for h, still in seen:
                left[h] = left.get(h, False) or still
            hashes.append([_signed(h) for h in left])
            there.append(list(left.values()))
            texts.append(_article(root))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(sigs, pa.int64()), pa.array(hashes, longs), pa.array(there, pa.list_(pa.bool_())), pa.array(texts, pa.string())],
            names=["page_id", "url", "key", "host", "sig", "hashes", "there", "text"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py(), frozenset(h % (1 << 64) for h in g.as_py())) for p, g in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, key, host, html; the key is equal for pages of one host with the same html."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.col("url").cast("string")
    return pages.select("page_id", url.alias("url"), F.md5(F.concat_ws("\n", host_of(url), html)).alias("key"), host_of(url).alias("host"), html.alias("html"))


def outlines(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): key, host, sig, hashes, there, and the text before template removal."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return _keyed(pages).mapInArrow(_outline, f"page_id {kind}, url string, key string, host string, sig long, hashes array<long>, there array<boolean>, text string")


def templates(outline: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash, n) of the subtrees that occur on at least ``min_pages`` different contents of a host."""
    counted = outline.select("host", "sig", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_pages)


def page_templates(outline: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key, host, hash, left) for every template subtree of every different page; left tells that no mark removes it."""
    held = outline.select("key", "host", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("there").alias("left"))).alias("h")).select("key", "host", "h.*")
    return held.distinct().join(scratch(templates(outline, min_pages).select("host", "hash"), "html-templates"), ["host", "hash"])


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null html is empty. Pages without a host (null url, or no ``://``) share the empty host.
    Repeated pages are one page in the counts and keep their rows; a null page_id stays null. Pages of any length
    are parsed whole. Only pages that hold a template subtree which no mark removes are parsed again.
    """
    outline = scratch(outlines(pages), "html-outline")
    hits = scratch(page_templates(outline, min_pages).where("left").groupBy("key").agg(F.collect_set("hash").alias("gone")), "html-hits")
    done = outline.join(hits.select("key"), "key", "left_anti").select("page_id", "url", "text")
    kind = pages.schema["page_id"].dataType.simpleString()
    again = _keyed(pages).join(hits, "key").select("page_id", "url", "html", "gone").mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return done.unionByName(again).withColumn("n_chars", F.length("text").cast("long"))
