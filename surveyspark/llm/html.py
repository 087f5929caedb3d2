"""Main text of web pages by removal of site templates.

Each page is parsed into its element tree. Block subtrees (menus, boxes,
lists, footers, paragraphs) get a hash of their tags and text; Spark counts on
how many different pages of its host each hash stands, and a subtree found on
many of them is template and is deleted. Two page-local rules follow, for hosts
with too few pages to count: elements that are never article text by tag, role
or class (scripts, forms, navigation, adverts, notices, comments, ...) go, and
where a page marks its article (``main``, ``article``) only that part stays.
Inside a marked article paragraphs and headings are never template, so articles
that quote the same passage or are syndicated keep it.

Text: character references decoded, white space in a block made one space,
blocks trimmed, empty ones left out, the rest joined in page order by newline.

Pages are counted by the hash of their markup, so copies of a page count once.
A hot host is split: rows are keyed by (host, subtree) and counted with
map-side partial sums; the join that marks the pages' subtrees is an ordinary
skew-splittable one. Only subtree hashes and the text move, never the markup.

Edge cases: null or empty markup gives the empty text; a null url counts as one
host of its own; repeated rows each get their row.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_batches

#: A subtree is template from so many different pages of its host on, however large the host.
MIN_PAGES = 3

# Element kinds and boilerplate words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
 figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section
 summary table tbody td tfoot th thead tr ul caption head title""".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption hgroup summary".split())
CONTAINER = frozenset("""address aside center details dialog dir div dl fieldset figure footer form header menu nav
 ol section table ul""".split())
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "head", "title"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
NONE: frozenset[str] = frozenset()
SCOPE = frozenset("ul ol dl table select body html".split())
NEVER_TAGS = frozenset("""script style noscript template nav footer aside form button select textarea iframe svg
 canvas object dialog menu head title input noembed noframes xmp audio video datalist""".split())
NEVER_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alert alertdialog menu menubar
 toolbar form""".split())
NEVER_WORDS = frozenset("""ad ads advert adverts advertisement advertisements adsense adsbygoogle banner
 breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer masthead menu
 modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion
 recommended related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription
 toolbar topbar widget widgets""".split())

RAW = "script|style|xmp|iframe|noembed|noframes|textarea|title"
#: After these a boilerplate word tells of the layout ("with-sidebar"), not the element.
LAYOUT = frozenset("no with has without hide hides".split())
#: Splits markup into text, raw elements, end tags, start tags and attributes.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<({RAW})\b[^>]*>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)"
    r"|</([a-z][^\s/>]*)[^>]*>|<([a-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|[^>]*)>", re.S | re.I)
OPEN_END = re.compile(r"<!--|<!\[CDATA\[", re.I)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


HAS_MARKS = re.compile(r"class|id|role|hidden|style", re.I)


@lru_cache(20_000)
def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER_TAGS or tag == "header" and not in_article:
        return True
    for name, value in MARKS.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif name == "role":
            if value.lower() in NEVER_ROLES:
                return True
        elif tag not in ("body", "html", "main"):
            for one in value.split():
                parts = [x.lower() for x in NAME_PARTS.findall(one)]
                if any(x in NEVER_WORDS and (not i or parts[i - 1] not in LAYOUT) for i, x in enumerate(parts)):
                    return True
    return False


class Open(NamedTuple):
    """An element still open while a page is read."""

    tag: str
    stream: list[str]  # its tags and texts in page order; closed elements in it are digests
    never: bool  # boilerplate by the page-local rules
    zone: int  # 2 in main, 1 in article, else 0
    mark: int  # the innermost candidate subtree around or with it, or -1
    own: int  # its own number among the candidates, or -1
    in_form: bool = False  # boilerplate only for the form around it


def shut_before(tag: str, stack: list[Open]) -> int:
    """The depth from which the start of ``tag`` closes open elements."""
    shut = CLOSED_BY.get(tag, NONE)
    depth, ends_p = len(stack), tag in CLOSES_P
    for i in range(len(stack) - 1, 0, -1):
        here = stack[i].tag
        if here in shut or ends_p and here == "p":
            depth = i
            if here == "p" or here == tag:
                break
        elif here in BLOCK and here not in ("td", "th", "dd", "dt", "tr"):
            break
    return depth


def closed_markup(markup: str) -> str:
    """``markup`` with each ``<`` after its last ``>`` as text, unless it opens a
    comment: such a tag never ends, and every one would be sought to the page's end."""
    at = markup.rfind(">") + 1
    if markup.find("<", at) < 0:
        return markup
    comment = OPEN_END.search(markup, at)
    to = comment.start() if comment else len(markup)
    return markup[:at] + markup[at:to].replace("<", "&lt;") + markup[to:]


def parse(markup: str) -> tuple[list[int], list[tuple[str, int, bool]], list[int]]:
    """Hashes of the page's block subtrees; its text blocks as (text, number of the
    innermost subtree around it or -1, whether the page-local rules keep it); for
    each subtree the number of the next one around it or -1, always a lower one."""
    hashes: list[int] = []  # of the candidate subtrees
    ups: list[int] = []
    stack = [Open("", [], False, 0, -1, -1)]
    stream = stack[-1].stream
    tags: Counter[str] = Counter()  # of the open elements
    blocks: list[tuple[list[str], Open]] = []
    block: list[str] = []

    def end_block() -> None:
        nonlocal block
        if block:
            blocks.append((block, stack[-1]))
            block = []

    def push(e: Open) -> None:
        nonlocal stream
        stack.append(e)
        tags[e.tag] += 1
        stream = e.stream

    def close(depth: int) -> None:
        nonlocal stream
        end_block()
        while len(stack) > depth:
            e = stack.pop()
            tags[e.tag] -= 1
            digest = xxhash.xxh64_intdigest("\0".join(e.stream).encode("utf-8", "surrogatepass"))
            if e.own >= 0:
                hashes[e.own] = digest - (1 << 64) if digest >= 1 << 63 else digest
            stream = stack[-1].stream
            stream.append(f"/{e.tag} {digest}")

    parts = TOKEN.split(closed_markup(markup))
    for at in range(0, len(parts), 5):
        text = parts[at]
        if text:
            text = html_lib.unescape(text) if "&" in text else text
            block.append(text)
            if not text.isspace():
                stream.append(" ".join(text.split()))
        if at + 1 == len(parts):
            break
        raw, ending, tag, attributes = parts[at + 1:at + 5]
        if ending:
            ending = ending.lower()
            if not tags[ending]:
                if ending not in BLOCK:
                    stream.append("/" + ending)
                continue
            for depth in range(len(stack) - 1, 0, -1):
                here = stack[depth].tag
                if here == ending:
                    close(depth)
                    break
                if here in SCOPE and ending in CLOSED_BY:
                    break  # a stray end tag closes nothing outside its list or table
        elif tag:
            tag = tag.lower()
            if tag == "br":
                block.append(" ")
                continue
            if tag not in BLOCK and not (attributes and HAS_MARKS.search(attributes)):
                stream.append(tag)
                continue
            if tag in VOID:
                end_block()
                continue
            if tag not in BLOCK:
                if is_boilerplate(tag, attributes, True):
                    end_block()
                    above = stack[-1]
                    push(Open(tag, [], True, above.zone, above.mark, -1))
                stream.append(tag)
                continue
            end_block()
            depth = shut_before(tag, stack)
            if depth < len(stack):
                close(depth)
            above = stack[-1]
            zone = 2 if tag == "main" or attributes and 'role="main"' in attributes else 1 if tag == "article" else 0
            around = above.never and not (zone and above.in_form)  # some sites wrap all of a page in a form
            never = around or is_boilerplate(tag, attributes, above.zone > 0)
            in_form = never and (above.in_form if around else tag == "form")
            zone = max(above.zone, 0 if never else zone)
            mark, own = above.mark, -1
            if tag in CONTAINER or tag in FLOW and not zone:
                own = len(hashes)
                hashes.append(0)
                ups.append(mark)
                mark = own
            push(Open(tag, [tag], never, zone, mark, own, in_form))
        elif raw:
            stream.append(raw)
    close(1)
    end_block()
    best = max((e.zone for pieces, e in blocks if not e.never and not all(map(str.isspace, pieces))), default=0)
    texts = ((" ".join("".join(pieces).split()), e) for pieces, e in blocks)
    return hashes, [(text, e.mark, not e.never and e.zone == best) for text, e in texts if text], ups


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES) -> DataFrame:
    """``id_col, url_col, text, n_chars, n_template`` (template subtrees deleted)
    per row."""
    kinds = dict(pages.dtypes)

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("host", "page", "subtrees", "ups", "texts", "marks")}
        for url, markup in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            subtrees, blocks, ups = parse(markup or "")
            kept = [(t, m) for t, m, keep in blocks if keep]
            out["host"].append(xxhash.xxh64_intdigest(host_of(url).encode("utf-8", "replace")) >> 1)
            out["page"].append(xxhash.xxh64_intdigest((markup or "").encode()) >> 1)
            out["subtrees"].append(subtrees)
            out["ups"].append(ups)
            out["texts"].append([t for t, _ in kept])
            out["marks"].append([m for _, m in kept])
        yield out | {"id": batch.column(0), "url": batch.column(1)}

    parsed = map_batches(
        pages.select(id_col, url_col, html_col), run,
        f"id {kinds[id_col]}, url string, host long, page long, subtrees array<long>, ups array<int>, "
        "texts array<string>, marks array<int>", rows=500)
    # written once without the texts: pages are parsed again for those
    narrow = cut(parsed.select("host", "page", F.array_distinct("subtrees").alias("subtrees")))
    seen = (narrow.select("host", "page", F.explode("subtrees").alias("subtree"))
            .groupBy("host", "subtree", "page").agg(F.lit(1).alias("one")))
    template = (seen.groupBy("host", "subtree").agg(F.sum("one").alias("n_pages"))
                .where(F.col("n_pages") >= min_pages).select("host", "subtree"))
    # pages that hold template, each with its list (bounded by the page itself)
    hits = (seen.join(template, ["host", "subtree"]).groupBy("host", "page")
            .agg(F.collect_set("subtree").alias("template")))
    cleaned = parsed.join(hits, ["host", "page"], "left")

    def delete(batch: pa.RecordBatch):
        out: dict[str, list] = {"id": batch.column(0), "url": batch.column(1), "text": [], "n_template": []}
        for subtrees, ups, texts, marks, template in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
            listed = set(template or ())
            gone: list[bool] = []
            for subtree, up in zip(subtrees, ups):  # those around come first
                gone.append(subtree in listed or up >= 0 and gone[up])
            out["text"].append("\n".join(t for t, m in zip(texts, marks) if m < 0 or not gone[m]))
            out["n_template"].append(len(listed))
        yield out

    done = map_batches(cleaned.select("id", "url", "subtrees", "ups", "texts", "marks", "template"), delete,
                       f"id {kinds[id_col]}, url string, text string, n_template int", rows=500)
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                       F.char_length("text").cast("long").alias("n_chars"), "n_template")
