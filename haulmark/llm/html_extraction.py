"""Main text of web pages by line-block distribution (operator 3).

Markup is stripped to lines, one for each block element. What the page itself sets apart (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden elements) leaves a stretch of empty lines, and so does the edge of an article.
Sums of text lengths over a sliding window of lines rise from nothing at surge points and fall to nothing at dive points. On every page
the text between such points is what can be kept: the ranges inside marked articles, unless a single range outside outweighs them all
by far (then the marks are teasers); without marks, the first range that isn't small beside the largest, and all ranges after it.

Elements are closed as HTML closes them: an open p, li, dt, dd, td, tr, option or heading ends where the next block implies its end.
Every step is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import row_pieces

#: A tag as HTML reads it (a quote matters after "=" only), and one that ends at the first ">". Possessive: neither ever backtracks.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
#: Elements whose content is text of another kind up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
APART = RAW | frozenset("head nav header footer aside form button select option datalist noscript template svg object canvas audio video menu dialog label fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = HEADINGS | {"p", "blockquote", "pre"}
#: What ends an open paragraph; what keeps the search for an open element from going further out.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SCOPES = frozenset("html table td th caption object template marquee".split())
SPECIAL = (BLOCKS | SCOPES | {"button", "select"}) - {"br", "hr"}
LOOSE = frozenset("address div p li dd dt".split())
TABLE_PARTS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "caption"), "tbody": ("tbody", "thead", "tfoot", "caption"), "thead": ("tbody", "thead", "tfoot", "caption"), "tfoot": ("tbody", "thead", "tfoot", "caption")}
#: Words of class, id or role that name what isn't the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar notice notices cookie cookies popup modal comment comments commentlist complementary contentinfo search".split())
#: Last parts of names that begin with such a word and still name it (ad-slot, comments-area, sidebar-left).
PLACES = frozenset("area bar block box container content inner item items left links list outer region right section slot top bottom unit wrap wrapper".split())
STATES = frozenset("has have with without no is not js show hide".split())
ROLES = frozenset("banner navigation search form alert complementary contentinfo dialog menu".split())
LISTING = frozenset("aside nav header footer menu".split())
COMMENTS = frozenset("comment comments commentlist".split())
#: Names that also stand in articles: they set nothing apart that is a paragraph or a heading, or that holds the page's headline.
SOFT = frozenset("banner header masthead modal promotion search".split())
#: Who writes what isn't the article, and what they write (user-reviews).
WRITERS, WRITINGS = frozenset("customer guest reader user visitor".split()), frozenset("comment comments feedback opinions replies responses review reviews".split())


def tokens(page: str):
    """(text, "", False, "") or ("", tag, whether it closes, attributes), in page order. Comments and declarations give nothing."""
    at, n, tag = 0, len(page), TAG
    last_end = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", False, ""
            return
        if lt > at:
            yield page[at:lt], "", False, ""
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif after in ("!", "?") or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif after == "/" or (after.isascii() and after.isalpha()):
            if lt > last_end:  # the page breaks off within a tag
                return
            m = tag.match(page, lt)
            if m is None:  # a quote swallows all that follows, so quotes aren't trusted any more
                tag = PLAIN_TAG
                m = tag.match(page, lt)
            if m is None:
                yield "<", "", False, ""
                at = lt + 1
                continue
            at = m.end()
            name = m[2].lower()
            yield "", name, bool(m[1]), m[3]
            if name in RAW and not m[1]:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    return
                at = end.start()
        else:
            yield "<", "", False, ""
            at = lt + 1


def attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs)} if attrs.strip(" /") else {}


def unseen(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")) is not None


def names_apart(name: str) -> bool:
    """A whole name, or one that ends with one (cookie-notice), or begins with one and ends with a place (ad-slot), not a state (has-sidebar)."""
    if name in NAMES:
        return True
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if len(parts) < 2 or parts[0] in STATES:
        return len(parts) == 1 and parts[0] in NAMES
    return parts[-1] in NAMES or (parts[0] in NAMES and parts[-1] in PLACES) or (parts[0] in WRITERS and parts[-1] in WRITINGS)


def soft(given: dict[str, str]) -> bool:
    """Whether all that names an element apart are words that also stand in articles."""
    names = [x for key in ("class", "id") for x in given.get(key, "").split() if names_apart(x)]
    return bool(names) and all((set(re.split(r"[^a-z0-9]+", x)) & NAMES) <= SOFT for x in names) and not ROLES.intersection(given.get("role", "").split())


def named_apart(given: dict[str, str]) -> bool:
    return any(names_apart(x) for key in ("class", "id") for x in given.get(key, "").split()) or bool(ROLES.intersection(given.get("role", "").split()))


class Elements:
    """The open elements of a page, ended as HTML implies. Every search looks at the top of a stack of places, so steps are constant."""

    def __init__(self):
        self.open: list[tuple[str, int]] = []
        self.of: dict[str, list[int]] = defaultdict(list)
        self.scopes, self.buttons, self.items, self.specials, self.tables = [], [], [], [], []
        self.ends: dict[int, int] = {}

    def lists(self, tag: str):
        if tag in SCOPES:
            yield self.scopes
        if tag in SCOPES or tag == "button":
            yield self.buttons
        if tag in SPECIAL:
            yield self.specials
            if tag not in LOOSE:
                yield self.items
        if tag in ("table", "template"):
            yield self.tables

    def cut(self, depth: int, now: int) -> None:
        while len(self.open) > depth:
            tag, began = self.open.pop()
            self.of[tag].pop()
            for x in self.lists(tag):
                x.pop()
            self.ends[began] = now

    def close(self, tags: tuple[str, ...], within: list[int], now: int) -> None:
        """Ends the innermost open element of tags, if none of within lies inside of it."""
        depth = max((self.of[t][-1] for t in tags if self.of[t]), default=-1)
        # an element may be in within itself
        limit = within[-1] if within and within[-1] != depth else within[-2] if len(within) > 1 and within[-1] == depth else -1
        if depth > limit:
            self.cut(depth, now)

    def start(self, tag: str, now: int) -> None:
        if self.of["head"] and tag not in IN_HEAD and tag != "head":
            self.cut(self.of["head"][-1], now)
        if tag in ENDS_P and self.of["p"]:
            self.close(("p",), self.buttons, now)
        if tag == "li":
            self.close(("li",), self.items, now)
        elif tag in ("dt", "dd"):
            self.close(("dt", "dd"), self.items, now)
        elif tag in TABLE_PARTS:
            self.close(TABLE_PARTS[tag], self.tables, now)
        elif tag in ("option", "optgroup"):
            self.close(("option",), self.specials[:-1] if self.specials and self.open[self.specials[-1]][0] == "option" else self.specials, now)
        elif tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.cut(len(self.open) - 1, now)
        elif tag == "a":
            self.close(("a",), self.specials, now)
        elif tag == "button":
            self.close(("button",), self.scopes, now)
        if tag in VOID:
            return
        for x in self.lists(tag):
            x.append(len(self.open))
        self.of[tag].append(len(self.open))
        self.open.append((tag, now))

    def end(self, tag: str, now: int) -> None:
        if tag in HEADINGS:
            self.close(tuple(HEADINGS), self.scopes, now)
        elif tag == "p":
            self.close(("p",), self.buttons, now)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption"):
            self.close((tag,), self.tables, now)
        elif tag in SPECIAL:
            self.close((tag,), self.scopes, now)
        elif self.of[tag]:
            self.close((tag,), self.specials, now)


def set_apart(found: list[tuple[str, str, bool, str]]) -> tuple[dict[int, int], dict[int, int]]:
    """Tokens that open an element set apart, with the token that ends it; and the same of articles. One never ended counts as its tag alone."""
    elements, opens = Elements(), []
    mains = np.zeros(len(found) + 1, np.int64)
    articles = np.zeros(len(found) + 1, np.int64)
    heads = np.zeros(len(found) + 1, np.int64)
    titles = np.zeros(len(found) + 1, np.int64)
    shut: list[tuple[int, int]] = []  # raw or unseen elements: what they hold marks no article
    for now, (_, tag, closing, attrs) in enumerate(found):
        if not tag:
            continue
        if closing:
            elements.end(tag, now)
            continue
        elements.start(tag, now)
        if tag in VOID:
            continue
        given = attributes(attrs)
        opens.append((now, tag, given))
        mains[now + 1] = tag == "main"
        articles[now + 1] = tag == "article"
        heads[now + 1] = tag in HEADINGS
        titles[now + 1] = tag == "h1"
    n, ends = len(found), elements.ends
    mains, articles, heads, titles = np.cumsum(mains), np.cumsum(articles), np.cumsum(heads), np.cumsum(titles)
    apart, marked = {}, {}
    until = 0
    inside: list[int] = []
    for now, tag, given in opens:
        if now < until:
            continue
        end = ends.get(now)
        while inside and inside[-1] <= now:
            inside.pop()
        named = tag in APART or (tag not in ("html", "body", "article", "main") and named_apart(given))
        hidden = tag not in ("html", "body") and unseen(given)
        if (named or hidden) and end is not None:
            holds_main = mains[end] > mains[now + 1]
            holds = holds_main or articles[end] > articles[now + 1]
            parts = [re.split(r"[^a-z0-9]+", x) for key in ("class", "id") for x in given.get(key, "").split()]
            commented = any(COMMENTS.intersection(x) or (x[0] in WRITERS and x[-1] in WRITINGS) for x in parts)
            stays = not hidden and tag not in RAW and (holds_main or (holds and tag not in LISTING and tag not in ("noscript", "template") and not commented))
            # an article's own header stays if it holds a headline
            stays = stays or (not hidden and tag == "header" and bool(inside) and heads[end] > heads[now + 1])
            stays = stays or (not hidden and tag not in APART and soft(given) and (tag in PARAGRAPHS or (bool(inside) and titles[end] > titles[now + 1])))
            if not stays:
                apart[now] = until = end
                continue
        if tag in ("article", "main"):
            marked[now] = n if end is None else end
            inside.append(marked[now])
    return apart, marked


def page_lines(page: str, window: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines of a page, their weights, and whether they stand in an article (see page_parts)."""
    return page_parts(page, window)[:3]


def page_parts(page: str, window: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a page: text, weight (its length; 0 for lines of links outside paragraphs), whether it stands in an article, and whether it is an h1.

    Stretches set apart and edges of articles are as many empty lines as a window has.
    """
    found = list(tokens(page))
    apart, marked = set_apart(found)
    lines, weight, inside, title = [], [], [], []
    words: list[str] = []
    links, paragraph, anchor, own, until, article, h1 = 0, False, False, False, 0, 0, False

    def flush(gap: bool = False) -> None:
        nonlocal links, paragraph, own
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            lines.append(text)
            weight.append(len(text) if article or (own and (paragraph or 2 * links <= len(text))) else 0)
            inside.append(article > 0)
            title.append(h1 and weight[-1] > 0 and 2 * links <= len(text))
        if gap:
            lines.extend([""] * window)
            weight.extend([0] * window)
            inside.extend([False] * window)
            title.extend([False] * window)
        links, paragraph, own = 0, False, False

    ends: list[int] = []
    for now, (text, tag, closing, _) in enumerate(found):
        while ends and ends[-1] <= now:
            ends.pop()
            flush(True)
            article = len(ends)
        if now < until:
            continue
        if text:
            text = html.unescape(text) if "&" in text else text
            words.append(text)
            if anchor:
                links += len(text.strip())
            if not own:
                own = any(map(str.isalnum, text))
            continue
        if not closing and now in apart:
            flush(True)
            until = apart[now]
            continue
        if tag in BLOCKS:
            flush()
            paragraph, h1 = not closing and tag in PARAGRAPHS, not closing and tag == "h1"
        elif tag in ("td", "th"):
            words.append(" ")
        if tag == "a":
            anchor = not closing
        if not closing and now in marked:
            flush(True)
            # an article that ends after the one around it ends with it
            ends.append(min(marked[now], ends[-1]) if ends else marked[now])
            article = len(ends)
    flush()
    return lines, np.array(weight, np.int64), np.array(inside, bool), np.array(title, bool)


def ranges(weight: np.ndarray, window: int) -> list[tuple[int, int]]:
    """From surge to dive: the stretches of lines in whose windows there is text, without the weightless lines at their ends."""
    if not len(weight):
        return []
    sums = np.convolve(weight, np.ones(window, np.int64))[window // 2 : window // 2 + len(weight)]
    edges = np.diff(np.r_[0, (sums > 0).astype(np.int8), 0])
    out = []
    for surge, dive in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        real = np.flatnonzero(weight[surge:dive])
        out.append((surge + int(real[0]), surge + int(real[-1]) + 1))
    return out


def chosen(lines: list[str], weight: np.ndarray, inside: np.ndarray, window: int = 3, share: float = 0.2, outweigh: int = 8, title: np.ndarray | None = None) -> list[str]:
    """The lines of the ranges that are the article. share: of the largest range, that begins the text where no article is marked, unless a
    range with the page's headline stands before it.
    outweigh: times the text of all marked ranges that a range outside needs for the marks not to count."""
    found = ranges(weight, window)
    if not found:
        return []
    totals = [int(weight[a:b].sum()) for a, b in found]
    marked = [bool(inside[a]) for a, _ in found]
    within = sum(t for t, m in zip(totals, marked, strict=True) if m)
    outside = max((t for t, m in zip(totals, marked, strict=True) if not m), default=0)
    if any(marked) and outside <= outweigh * max(within, 250):
        keep = [r for r, m in zip(found, marked, strict=True) if m]
    else:
        rest = [(r, t) for r, t, m in zip(found, totals, marked, strict=True) if not m]
        heads = [bool(title[a:b].any()) if title is not None else False for (a, b), _ in rest]
        first = next(k for k, (_, t) in enumerate(rest) if heads[k] or t >= share * outside)
        keep = [r for r, _ in rest[first:]]
    return [lines[i] for a, b in keep for i in range(a, b) if lines[i]]


def main_text(page: str | None, window: int = 3) -> str:
    """The article of a page: its blocks, one a line."""
    if not page:
        return ""
    lines, weight, inside, title = page_parts(page, window)
    return "\n".join(chosen(lines, weight, inside, window, title=title))


def extract_rows(batches):
    for batch in row_pieces(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_extraction(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (its blocks in page order, one a line) and n_chars (code points).

    Null and empty pages, and pages without an article, have empty text. Repeated rows come back each. Other columns don't matter;
    an empty table gives an empty result. Time and memory of a page are linear in its length, whatever its markup.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract_rows, "page_id long, url string, text string, n_chars long")
