"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page.  Lines of containers that never hold the article (menus,
headers, footers, sidebars, notices, adverts, forms, comments) count as length 0 but keep their place, so that gaps
show.  Text lengths without links are summed over a sliding window of lines; the text surges where the sum rises from
nothing and passes the level, and dives where the sum is back at nothing.  What lies between a surge and its dive is
kept, all of its lines.

A marked article (``article``, ``main``) is evidence, not a verdict.  Stretches end at its borders, and inside a level
of one character has to be passed: lines of links alone at the ends of a stretch have no length and are left out.  A
stretch outside is kept beside it where it passes the full level and is denser (by its largest sum) or longer than every
marked article of the page.
"""

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^<>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")

# Element names (fixed by HTML)
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"))
SPACES = frozenset(("br", "td", "th", "img", "wbr", "input"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SELF_CLOSING = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th"))  # may lack an end tag
# Elements, roles and words of classes and ids whose content is not the article
ASIDE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "canvas",
                   "object", "audio", "video", "map", "search", "datalist", "fieldset"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert",
                   "menu", "menubar", "form", "toolbar", "note", "status"))
NAMES = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"))
MAIN_NAMES = frozenset(("article", "content", "entry", "main", "post", "story", "text"))  # as a whole class or id
HEADER_NAMES = frozenset(("header", "masthead"))
COMMENT_NAMES = frozenset(("comment", "comments", "disqus", "replies", "respond"))
ARTICLE = frozenset(("article", "main"))


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _beside(tag: str, attributes: dict[str, str]) -> str:
    """"aside" for an element whose content is beside the article, "header" if headings in it may be the article's, or "".

    Any word of a class or id tells, as in ``post-comments``; a class or id that as a whole names the article lifts that.
    """
    if tag in ASIDE or tag in RAW:
        return "header" if tag == "header" else "aside"
    if not attributes or tag in ("html", "body"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES:
        return "aside"
    tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    names = {w for t in tokens for w in _NAME.findall(t)} & NAMES
    if not names or any(t in MAIN_NAMES for t in tokens) or tag in ARTICLE and not names & COMMENT_NAMES:
        return ""
    return "header" if names <= HEADER_NAMES else "aside"


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """``(text, characters outside links, marked article)`` of every block; beside-the-article blocks are empty.

    Outermost marked articles are numbered from 1; 0 is outside.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    own = link = article = number = 0
    skipped, kind, depth, headings = "", "", 0, 0  # the element being passed over, how deep in its own name
    opened = nested = 0  # containers and articles open inside it

    def close():
        nonlocal own
        text = " ".join("".join(parts).split())
        if text or not out or out[-1][0]:
            out.append((text, own if text else 0, number if article else 0))
        parts.clear()
        own = 0

    def add(raw: str):
        nonlocal own
        if raw and (not skipped or headings):
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not link:
                own += len(text)

    position = 0
    while True:
        match = _TOKEN.search(page, position)
        add(page[position:match.start()] if match else page[position:])
        if not match:
            break
        position = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing = match[1] == "/"
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, position)
            position = end.end() if end else len(page)
            continue
        if skipped:
            if kind == "header" and article and re.fullmatch("h[1-6]", tag):
                close()
                headings = 0 if closing else 1
            ends = again = False  # whether it ends here, and whether this tag is then still to be looked at
            if tag in ARTICLE and tag != skipped:
                if closing and not nested:
                    ends = again = bool(article)  # an element left open ends with the article around it
                else:
                    nested += -1 if closing else 1
            if not ends and skipped not in SELF_CLOSING:
                if tag == skipped:
                    depth += -1 if closing else 1
                    ends = depth <= 0
            elif not ends and tag == skipped and not opened:
                ends, again = True, not closing
            elif not ends and skipped == "p":
                ends = again = tag in BLOCKS
            elif not ends and tag in BLOCKS and tag not in SELF_CLOSING and tag not in VOID:
                if closing and not opened:
                    ends = again = True  # so does one without an end tag with what it stands in
                else:
                    opened += -1 if closing else 1
            if not ends:
                continue
            skipped, headings = "", 0
            close()
            if not again:
                continue
        if tag in BLOCKS:
            close()
        elif tag in SPACES:
            parts.append(" ")
        if closing:
            if tag in ARTICLE:
                article = max(0, article - 1)
            elif tag == "a":
                link = 0
            continue
        if tag in VOID or match[3].endswith("/") and tag not in BLOCKS:
            continue
        if kind := _beside(tag, _attributes(match[3])):
            close()
            out.append(("", 0, number if article else 0))
            skipped, depth, opened, nested = tag, 1, 0, 0
        elif tag in ARTICLE:
            number += not article
            article += 1
        elif tag == "a":
            link = 1
    close()
    return out


def _stretches(sizes: list[int], width: int) -> list[tuple[range, int]]:
    """From surge to dive, first to last line with a size, and the largest sum, of every run of sums above nothing."""
    sums = [sum(sizes[i:i + width]) for i in range(len(sizes))]
    out, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        own = [j for j in range(i, min(end + width - 1, len(sizes))) if sizes[j]]
        out.append((range(own[0], own[-1] + 1), max(sums[i:end])))
        i = end
    return out


def main_text(page: str | None, width: int = 3, level: int = 86, marked_level: int = 1) -> str:
    """The article's blocks, one per line."""
    lines = lines_of(page) if page else []
    inside: dict[int, list[int]] = {}
    for i, (_, _, mark) in enumerate(lines):
        if mark:
            inside.setdefault(mark, []).append(i)
    kept: set[int] = set()
    dense = long = 0  # of the marked articles
    for places in inside.values():
        sizes = [lines[i][1] for i in places]
        found = _stretches(sizes, width)
        kept.update(places[j] for part, most in found if most >= marked_level for j in part)
        dense = max(dense, max((most for _, most in found), default=0))
        long = max(long, sum(sizes))
    marked = any(lines[i][0] for i in kept)
    sizes = [0 if mark else own for _, own, mark in lines]
    found = [(part, most, sum(sizes[j] for j in part)) for part, most in _stretches(sizes, width)]
    passed = [part for part, most, total in found
              if most >= level and (not marked or most > dense or total > long)]
    if not passed and not marked:
        passed = [part for part, _, _ in sorted(found, key=lambda f: -f[2])[:1]]
    kept.update(j for part in passed for j in part if not lines[j][2])
    return "\n".join(lines[j][0] for j in sorted(kept) if lines[j][0])


def _text_columns(width: int, level: int):
    def run(batches):
        for batch in sliced(batches, 256):
            texts = [main_text(h.decode("utf-8", "replace") if h else None, width, level) for h in as_bytes(batch.column(2))]
            yield batch.column(0), batch.column(1), texts, [len(t) for t in texts]
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", width: int = 3,
            level: int = 86) -> DataFrame:
    """``(<id>, <url>, text, n_chars)`` for every row, the whole page read, nothing cut.

    Null and empty pages, and pages without any text, have an empty text.  A page without a stretch that passes the
    level and without marked text keeps its longest one.  Repeated rows repeat; rows with a null id or URL are kept.  An
    empty table gives an empty result.
    """
    rows = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), pages[html_col].alias("_html"))
    out = arrow_map(rows, _text_columns(width, level), fields(
        rows, StructField("text", StringType()), StructField("n_chars", LongType()), keep=("_id", "_url")))
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
