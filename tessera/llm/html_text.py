"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one per block element), each with its text
length, the length of its link text and the region it stands in. Text lengths
without links are summed over a sliding window of lines; the text surges
where the sum rises to a share of the page's peak and dives where it falls to
nothing again, and the lines from surge to dive are kept. Lines inside menus,
page headers, footers, sidebars, notices, adverts, forms and reader comments
(by element, role, or a word of class or id) never count, except that inside
an article a region whose words alone speak against it (``related-work``)
stays where its own lines surge. Menus, headers, footers and sidebars separate
stretches; text that goes on behind one of them
in the same container needs no new surge. Surges and dives choose on all
pages. Where a page marks articles (``article``, ``main``), text inside weighs
double, links included, and an article with a surge is kept whole; if the
articles' chosen text weighs as much as the chosen text outside them, they
bound the choice and nothing outside is kept.

Scale: each page is handled by itself in one pass over its tags; no shuffle.

Cases: NULL or empty html, or a page without text, gives '' and 0; unclosed
tags, comments and scripts end with the page, and a tag whose quotes do not
pair with its first ">" (reading takes time in proportion to the page); text
without markup is one line. Rows with NULL ids or urls and repeated rows are returned as they are.
Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
_REST = r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+"  # of a tag: quoted values as a whole; no two ways to read it
#: Comments, elements without text, tags and declarations. The last alternative takes a tag whose quotes do not
#: pair, up to the first ">" or the page's end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b" + _REST + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(" + _REST + r")>|<[!?][^>]*+>|<(?P<odd>/?[a-zA-Z][^>]*+)(?:>|\Z)", re.S | re.I)
#: The same without quotes, for what follows a tag whose quotes do not pair: every character is then looked at once.
LOOSE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|<(?P<odd>/?[a-zA-Z][^>]*+)\Z", re.S | re.I)
TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(.*)", re.S)


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is it a closing tag, element or '', attributes) of every token."""
    pattern, at = TOKEN, 0
    while (m := pattern.search(page, at)) is not None:
        at = m.end()
        if m["odd"] is not None:
            pattern = LOOSE
            if page.endswith(">", m.start(), at):
                t = TAG.match(m["odd"])
                yield m.start(), at, bool(t[1]), t[2].lower(), t[3]
            else:  # cut off inside the tag
                yield m.start(), at, False, "", ""
        else:
            yield m.start(), at, bool(m[2]), (m[3] or "").lower(), m[4] or ""


#: Elements whose text runs on in the line around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr math mi mn mo mtext mrow msub msup msubsup mfrac msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
AWAY = frozenset("nav footer aside form button menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
#: Words of class or id that mark a region that is not main text, not even where it holds an article element.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted cookie cookies "
    "consent gdpr newsletter subscribe subscription signup login comment comments disqus replies respond outbrain taboola".split())
#: The same, but layouts also wrap the article in such regions: an article element inside one counts. Inside an
#: article the words are also those of plain prose ("related-work"): there the line blocks decide.
LAYOUT = frozenset(
    "related recommended recommendations discussion disclaimer banner notice notices alert popup modal overlay share sharing social sidebar sidebars side menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer foot masthead topbar widget widgets pagination pager toolbar search".split())
NONE, LAYOUT_HINT, HINT, LANDMARK = 0, 1, 2, 3
MAIN = frozenset(("article", "main"))
#: Elements that hold a line or a list of them, not a part of the page.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 span blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th figure figcaption".split())
BONUS = 2  # weight of text in an article or main element
ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _away(tag: str, attrs: str, in_main: bool) -> int:
    """How an element excludes its text: NONE, LAYOUT_HINT, HINT or LANDMARK."""
    if tag in AWAY or tag == "header" and not in_main:
        return LANDMARK
    level = LAYOUT_HINT if tag == "fieldset" else NONE
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            if value.lower() in ROLES:
                return LANDMARK
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or \
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return LANDMARK
        elif name in ("class", "id") and tag not in ("html", "body"):
            words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)}
            if not words & {"no", "without", "has", "with"}:
                layout = words & LAYOUT or "header" in words and not in_main
                level = max(level, HINT if words & HINTS else LAYOUT_HINT if layout else NONE)
    return level


def lines(page: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(text, characters outside links, number of the article it stands in or 0, how it is excluded, number of its container or 0)."""
    stack: list[tuple[str, int, int, int]] = []  # tag, how it is excluded, article, container
    away, article, articles, link, at, boxes = NONE, 0, 0, 0, 0, 0
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        row = (text, max(0, len(text) - linked), article, away, stack[-1][3] if stack else 0)
        parts, linked = [], 0
        return row

    def put(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    for start, end, closing, tag, attrs in tokens(page):
        put(page[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE and tag != "wbr" and not (tag == "span" and not closing and _away(tag, attrs, bool(article))):
            if tag == "a":
                link = 0 if closing else 1
            if tag == "span" and closing and stack and stack[-1][0] == "span" and stack[-1][1]:
                pass
            else:
                if tag == "span" and not closing and stack and stack[-1][0] == "span":
                    stack.append(("span", away, article, stack[-1][3]))
                continue
        if tag == "wbr":
            continue
        row = flush()
        if row[0]:
            yield row
        if tag in VOID:
            continue
        if not closing:
            if attrs.endswith("/") and tag not in ("p", "div", "section", "article", "main"):
                continue
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and not attrs:
                continue  # no region of its own, and often left open
            own = _away(tag, attrs, bool(article))
            if tag in MAIN and own <= LAYOUT_HINT and away <= LAYOUT_HINT:
                if not article:
                    articles += 1
                    article = articles
                away = NONE
            else:
                away = max(away, own)
            if tag not in TEXT and tag not in ("html", "body"):
                boxes += 1
                box = boxes
            else:
                box = stack[-1][3] if stack else 0
            stack.append((tag, away, article, box))
        else:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if found is not None:
                del stack[found:]
                away, article = (stack[-1][1], stack[-1][2]) if stack else (NONE, 0)
            if tag in ("html", "body"):
                stack.clear()
                away, article = NONE, 0
    put(page[at:])
    row = flush()
    if row[0]:
        yield row


def main_text(page: str | None, window: int = 3, surge: float = 0.25, enough: int = 200) -> str:
    """The page's main text, one block per line. A window surges at ``surge`` of the page's peak, or at ``enough`` characters."""
    # stretches of lines that no menu, header, footer or sidebar, and no change of article, interrupts
    stretches: list[list[tuple[str, int, int]]] = []  # text, weight, weight if the line blocks of its region let it count
    marks: list[int] = []  # the stretch's article or 0
    follows: list[bool] = []  # does it go on in the container in which the one before it was interrupted
    region: int | None = None
    last = 0
    for text, weight, article, away, box in lines(page or ""):
        unsure = away == LAYOUT_HINT and article
        if away and not unsure:
            if away == LANDMARK:
                region = None
            continue
        if article != region:
            follows.append(bool(stretches) and region is None and article == marks[-1] and box == last != 0)
            stretches.append([])
            marks.append(article)
            region = article
        stretches[-1].append((text, 0, BONUS * weight) if unsure else (text, BONUS * len(text) if article else weight, -1))
        last = box
    over = lambda weights: [sum(weights[i:i + window]) for i in range(len(weights))]
    sums = [over([w for _, w, _ in s]) for s in stretches]
    peak = max((x for s in sums for x in s), default=0)
    rise = max(1.0, min(peak * surge, float(enough)))
    # inside an article a region that only its words speak against stays if its own lines surge, from surge to dive
    for k, s in enumerate(stretches):
        i = 0
        while i < len(s):
            j = i
            while j < len(s) and s[j][2] >= 0:
                j += 1
            if j > i:
                own = over([w for _, _, w in s[i:j]])
                kept = set(_surges(own, rise, False)[0])
                s[i:j] = [(t, w, -1) if n in kept else ("", 0, -1) for n, (t, _, w) in enumerate(s[i:j])]
            i = max(j, i + 1)
        sums[k] = over([w for _, w, _ in s])
    chosen: list[list[int]] = []  # line numbers by stretch
    running = False
    for block, goes_on in zip(sums, follows, strict=True):
        kept, running = _surges(block, rise, running and goes_on)
        chosen.append(kept)
    inside, outside = (sum(s[i][1] for s, c, a in zip(stretches, chosen, marks, strict=True) for i in c if bool(a) == of) for of in (True, False))
    # where the page's marks hold most of the text that was chosen, they bound it: articles with a surge are whole, the rest is off
    surged = {a for a, c in zip(marks, chosen, strict=True) if a and c}
    kept = []
    for s, c, a in zip(stretches, chosen, marks, strict=True):
        if a in surged:
            kept += [text for text, _, _ in s]
        elif not inside or inside < outside:
            kept += [s[i][0] for i in c]
    return "\n".join(t for t in kept if t)


def _surges(sums: list[int], rise: float, running: bool) -> tuple[list[int], bool]:
    """Lines from every surge to its dive, and whether the text still runs at the end. ``running``: it does at the start."""
    out: list[int] = []
    i = 0
    while i < len(sums):
        if sums[i] < rise and not running:
            i += 1
            continue
        j = i  # the dive: no text outside links in the window any more
        while j < len(sums) and sums[j] > 0:
            j += 1
        out += range(i, j)
        running = j == len(sums)
        i = max(j, i + 1)
    return out, running and len(sums) - 1 in out


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, whole html."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
