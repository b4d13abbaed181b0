"""Main text of web pages by tag-path ratios.

A page is scanned once into blocks: runs of text between block-level tags, with the path of open elements from the root (name, and first
class or id). What can't be article text is left out by what HTML says of it: scripts, styles, forms, nav, aside, footer, page
headers, hidden parts, and elements whose class, id or role names a menu, sidebar, notice, advert, share bar or reader comments.

For the rest, per path: text length and punctuation per block, the length less what is in links. Both ratios are smoothed over
neighbouring paths in page order, weighted by a Gaussian and by how much of the path they share, fused as their geometric mean, and compared with
a share of the spread of fused values over the page's blocks. Blocks on paths above that are content; the article is the element that holds them: from the heaviest one
upwards as long as what an ancestor adds is mostly on such paths, and out to an enclosing article or main element. All text of that
element counts, so that short paragraphs and headings stay.

Pages are independent and one row each, so nothing is shuffled. Null and empty pages give an empty text. Broken markup is read as browsers do:
p, li, td and the like end implicitly, stray end tags are skipped, an unclosed comment or script takes the rest. Repeated rows give repeated results, an
empty table none; other columns are not read, whatever their names. Very long pages take time and memory in proportion.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import batch_of, column, query, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that stand within a line of text and end no paragraph.
INLINE = frozenset("""a abbr audio b bdi bdo big button canvas cite code data datalist del dfn em font i iframe ins kbd label map mark math meter nobr noscript object output picture
                   progress q rp rt ruby s samp script select small span strike strong style sub sup svg template textarea time tt u var video input img br wbr""".split())
DROPPED = frozenset("""script style textarea title xmp iframe noembed noframes noscript template svg math head nav aside footer form fieldset button select datalist object canvas
                    audio video dialog menu""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
HOLDERS = frozenset("article main section div body td center".split())
CELLS = frozenset("td th table caption".split())
TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: Nesting beyond this many open elements is not followed, as in browsers.
DEPTH = 512
#: Opening one of these ends an open element of its list, within the nearest of the scopes.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "thead": ("tr", "td", "th", "thead", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPES = frozenset("html body table ul ol dl select article main section div nav aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that name what is not the article.
CUES = frozenset(("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments commentlist disqus respond replies cookie cookies consent gdpr "
                  "notice notices notification alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav widget widgets "
                  "footer header masthead topbar share sharing social related recommended recommendations toolbar pagination pager skip search paywall").split())

REPLIES = frozenset("comment comments replies".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
MARKS = re.compile(r"[.,;:!?…、。，．：；？！؟،।]")


class Element:
    """An open element: its name, step of the path, and what of its text counts."""

    __slots__ = ("above", "article", "depth", "headed", "header", "kept", "linked", "name", "step", "within")

    def __init__(self, name: str, above: Element | None, step: str = "", kept: bool = True, main: bool = False):
        self.name, self.above, self.step, self.kept = name, above, step, kept
        self.depth = above.depth + 1 if above else 0
        self.within = name == "article" or bool(above and above.within)
        self.article = main or self.within or bool(above and above.article)
        self.linked = name == "a" or bool(above and above.linked)
        self.headed = name in HEADINGS or bool(above and above.headed)
        self.header = name == "header" or bool(above and above.header)

    @property
    def path(self) -> str:
        return "/".join(reversed([e.step for e in _line_of(self)]))


class Block:
    """A run of text: its innermost block-level element, its text, and how much of it is in links."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _opened(name: str, attributes: str, above: Element, dropped: frozenset) -> Element:
    kept, step, main = above.kept and name not in dropped, name, name == "main"
    if attributes.strip(" \t\r\n\f/"):
        found = {}
        for key, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(key.lower(), "".join(values))
        label = found.get("class", "").split()[:1] or found.get("id", "").split()[:1]
        step = f"{name}.{label[0]}" if label else name
        main = main or found.get("role", "").lower() == "main" or "articleBody" in found.get("itemprop", "").split()
        if kept and name not in ("html", "body"):
            style = found.get("style", "").replace(" ", "").lower()
            cues = REPLIES if main or name == "article" else CUES
            kept = not ("hidden" in found or "display:none" in style or found.get("role", "").lower() in ROLES or any(_names_other(found.get(k, ""), cues) for k in ("class", "id")))
    if name == "header":
        kept = kept and above.article  # of its own header an article keeps the headings
    return Element(name, above, step, kept, main)


def _names_other(value: str, cues: frozenset) -> bool:
    """Whether a class or id names something beside the article; "no", "has" and "with" before a cue only describe the page."""
    for name in value.split():
        before = ""
        for word in WORDS.findall(name):
            word = word.lower()
            if word in cues and before not in ("no", "has", "with", "without"):
                return True
            before = word
    return False


def blocks(page: str, dropped: frozenset = DROPPED) -> list[Block]:
    """The page's blocks that may be article text, in page order."""
    now, out, parts, linked, at, lower = Element("#page", None), [], [], 0, 0, ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            element = now
            while element.name in INLINE:
                element = element.above
            out.append(Block(element, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def taken(text: str) -> None:
        nonlocal linked
        if text and now.kept and (now.headed or not now.header):
            text = html.unescape(text)
            parts.append(text)
            linked += len(text) * now.linked

    def close(names, scopes) -> None:
        """End the outermost element of `names` below the nearest of the scopes."""
        nonlocal now
        last = None
        for e in _line_of(now):
            if e.name in names:
                last = e
            elif e.name in scopes:
                break
        if last:
            if last.name not in INLINE:
                flush()
            now = last.above

    while at < len(page):
        opening = page.find("<", at)
        if opening < 0:
            taken(page[at:])
            break
        token = TOKEN.match(page, opening)
        if not token:  # a lone < is text
            taken(page[at : opening + 1])
            at = opening + 1
            continue
        taken(page[at:opening])
        at = token.end()
        name = (token.group(2) or token.group(5) or "").lower()
        if not name or page[at - 1] != ">":
            continue
        if name in VOID:
            if name == "br":
                taken(" ")
            elif name not in INLINE:
                flush()
            continue
        if token.group(1) or token.group(4):
            for e in _line_of(now):
                if e.name == name:
                    if name not in INLINE:
                        flush()
                    now = e.above
                    break
                if e.name not in INLINE and name in INLINE or e.name in CELLS and name not in TABLE:
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name == "a" and now.linked:
            close(("a",), CELLS)
        if name not in INLINE:
            flush()
            close(("p",), SCOPES)
            if name in HEADINGS:
                close(HEADINGS, SCOPES)
            if name in ENDS:
                close(ENDS[name], SCOPES)
        if now.depth < DEPTH or name in RAW:
            now = _opened(name, token.group(3) or token.group(6) or "", now, dropped)
        if name in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else _found(page, name, at)
            at = len(page) if end < 0 else end
    flush()
    return out


def _found(page: str, name: str, at: int) -> int:
    """Where the end tag stands in a page whose lower case has another length."""
    end = re.compile(f"</{name}", re.I).search(page, at)
    return end.start() if end else -1


def path_scores(found: list[Block], paths_of: dict[Element, str], reach: int = 2, width: float = 0.5) -> dict[str, float]:
    """The fused ratio of each path: per block, text that is no link, and punctuation, smoothed over neighbouring paths."""
    totals: dict[str, list[float]] = {}
    for b in found:
        t = totals.setdefault(paths_of[b.element], [0, 0, 0])
        t[0] += 1
        t[1] += len(b.text) - b.linked
        t[2] += len(MARKS.findall(b.text))
    paths = list(totals)
    steps = [p.split("/") for p in paths]
    ratios = np.array([(t[1] / t[0], t[2] / t[0]) for t in totals.values()])
    smooth = np.zeros_like(ratios)
    for i in range(len(paths)):
        near = range(max(0, i - reach), min(len(paths), i + reach + 1))
        weights = [math.exp(-((i - j) ** 2) / (2 * width * width)) * _shared(steps[i], steps[j]) for j in near]
        smooth[i] = np.average(ratios[near.start : near.stop], axis=0, weights=weights)
    fused = np.sqrt(smooth[:, 0] * (1 + smooth[:, 1]))
    return dict(zip(paths, fused.tolist(), strict=True))


def _shared(a: list[str], b: list[str]) -> float:
    """The share of two paths' steps that they have in common from the root, 1 for equal paths, never 0."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return (same / max(len(a), len(b))) ** 2 + 1e-9


def main_blocks(found: list[Block], strict: float = 1.0) -> list[Block]:
    """The blocks of the article."""
    candidates = [b for b in found if b.element.article] or found
    if not candidates:
        return []
    paths = {e: e.path for e in {b.element for b in candidates}}
    scores = path_scores(candidates, paths)
    each = np.array([scores[paths[b.element]] for b in candidates])
    limit = min(strict * float(each.std()), float(each.max()))  # the best path is always content
    content = {p for p, s in scores.items() if s >= limit and s > 0} or set(scores)
    inside: dict[Element, list[int]] = {}  # text below each element, without headings: all, on content paths
    heaviest: dict[Element, float] = {}
    for b in candidates:
        good, size = paths[b.element] in content, 0 if b.element.headed else len(b.text)
        if good:
            heaviest[b.element] = heaviest.get(b.element, 0) + scores[paths[b.element]] * len(b.text)
        for e in _line_of(b.element):
            t = inside.setdefault(e, [0, 0])
            t[0] += size
            t[1] += size * good
    top = max(heaviest, key=heaviest.get)
    while top.above and (top.name not in HOLDERS or top.above.within or _mostly(inside[top.above], inside[top])):
        top = top.above
    return [b for b in found if top in _line_of(b.element)]


def _mostly(outer: list[int], inner: list[int]) -> bool:
    """Whether what the outer element adds is mostly on content paths."""
    return 2 * (outer[1] - inner[1]) >= outer[0] - inner[0]


def _line_of(element: Element | None) -> Iterator[Element]:
    while element:
        yield element
        element = element.above


def main_text(page: str | None) -> str:
    """The article's blocks, joined by empty lines. A form that wraps the whole page is no form."""
    found = blocks(page or "") or blocks(page or "", DROPPED - {"form"})
    return "\n\n".join(b.text for b in main_blocks(found))


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield batch_of(OUT, batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    flat = pages.select(column(pages, page_id, "long").alias("page_id"), column(pages, url, "string").alias("url"), column(pages, body, "string").alias("html"))
    return flat.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


@query("op11_html_extraction", """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: trim(regexp_replace(
        regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c""")
def op11_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
