"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles, comments, forms and the zones that tags or class names mark as menus,
headers, footers, sidebars, notices, adverts and reader comments lose their text; block elements become lines. A class
or id that holds most of the page's text marks no zone. The text lengths of ``WINDOW`` neighbouring lines, without
their links, are then summed over the lines left: the sum surges where the main text starts and dives to nothing where
it ends. All stretches between a surge and a dive are the main text.

Where the page marks its article (``article``, ``main`` or role=main with text) surge and dive decide whether the mark is
believed: it isn't if one stretch outside is longer than all text inside. Inside a believed mark every line that is in no zone is
main text, lists of links and short lines included. There, headings keep their text in a ``header`` too, and names that
say little (``TEASERS``: related, promo, side) mark a zone only where it is short or mostly links.

Pages are independent: one pass, no shuffle, memory for one batch of pages.

Defined results: null html counts as empty; no main text gives an empty string; broken and unclosed markup is read as
far as it goes; repeated rows give repeated results; an empty table gives an empty result; very long pages are read whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purlin.llm.common import quoted, ship

WINDOW = 3
THRESHOLD = 86  # characters in a window for a surge on pages that don't mark their article
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|object|canvas|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
# Block-level elements, elements without an end tag, and zones without main text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ZONES = frozenset("nav footer aside form menu dialog button head header label option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html"}
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebars?|side|widgets?|cookies?\w*|consent|notices?|alerts?|gdpr|newsletter|subscribe|comments?|commentlist|respond|replies|disqus\w*|related|recommended|share|sharing|social|pagination|pager|toolbar|popup|modal|skip|login|search)(?:$|[\s_-])",
    re.I,
)
TEASERS = re.compile(r"(?:^|[\s_-])(?:promo\w*|side|related|recommended)(?:$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|respond|replies|disqus\w*)(?:$|[_-])", re.I)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    """Values by name; of a repeated name the first."""
    found: dict[str, str] = {}
    for m in ATTR.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _texts(found: list[tuple[str, bool, tuple[str, ...], bool, int]]) -> set[str]:
    """Names that look like teasers but hold text of the article: long enough, and less than half of it links."""
    held: dict[str, tuple[int, int]] = {}
    for text, zone, names, article, linked in found:
        if article and not zone:
            for name in names:
                n, of = held.get(name, (0, 0))
                held[name] = (n + len(text), of + linked)
    return {k for k, (n, of) in held.items() if TEASERS.search(k) and n >= THRESHOLD and 2 * of < n}


def _wrappers(found: list[tuple[str, bool, tuple[str, ...], bool, int]]) -> set[str]:
    """Names that look like boilerplate but wrap most of the page's text, and all text of its article."""
    held: dict[str, int] = {}
    total = marked = 0
    inside: dict[str, int] = {}  # of the article's text
    for text, zone, names, article, linked in found:
        if not zone:
            n = max(0, len(text) - linked)
            total += n
            marked += n if article else 0
            for name in names:
                held[name] = held.get(name, 0) + n
                inside[name] = inside.get(name, 0) + (n if article else 0)
    # readers' comments may well be longer than the text they are about
    return {k for k, n in held.items() if n >= THRESHOLD and 2 * n > total and inside[k] == marked and (total - n < THRESHOLD or not READERS.search(k))}


def lines(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, in a zone without main text, in the marked article, characters in links) of each block, in page order."""
    out: list[tuple[str, bool, tuple[str, ...], bool, int]] = []
    stack: list[tuple[str, bool, tuple[str, ...], bool]] = []  # tag, opens such a zone, its boilerplate names, opens the article
    names: dict[str, int] = {}  # boilerplate names of the open elements
    zones = articles = links = linked = headers = 0
    parts: list[str] = []
    at = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text) if links else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                titled = headers > 0 and zones == headers and articles > 0 and any(e[0] in HEADINGS for e in stack)
                out.append((text, zones > 0 and not titled, tuple(names), articles > 0, linked))
            parts.clear()
        linked = 0

    def leave(upto: int) -> None:
        nonlocal zones, articles, links, headers
        while len(stack) > upto:
            tag, zone, called, article = stack.pop()
            for name in called:
                names[name] -= 1
                if not names[name]:
                    del names[name]
            links -= tag == "a"
            zones -= zone
            headers -= zone and tag == "header"
            articles -= article

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCKS or tag in ZONES:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:  # a stray inline end tag closes no block
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS or tag in ZONES:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        leave(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if tag == "li" and stack and stack[-1][0] == "li":
                leave(len(stack) - 1)
        if tag in VOID or m["attrs"].rstrip().endswith("/"):
            continue
        a = _attributes(m["attrs"])
        article = tag in ("article", "main") or a.get("role", "").lower() == "main"
        zone = tag in ZONES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES
        called: tuple[str, ...] = ()
        if not zone and tag not in ("body", "html", "main") and (tag in BLOCKS or tag == "span"):
            if not (article and tag == "article" and "comment" not in (a.get("class", "") + a.get("id", "")).lower()):
                called = tuple({name for name in (*a.get("class", "").split(), *a.get("id", "").split()) if BOILER.search(name)})
        stack.append((tag, zone, called, article))
        for name in called:
            names[name] = names.get(name, 0) + 1
        zones += zone
        headers += zone and tag == "header"
        articles += article
        links += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    kept = _wrappers(out) | _texts(out)
    return [(text, zone or any(name not in kept for name in called), article, linked) for text, zone, called, article, linked in out]


def _runs(size: list[int], least: int) -> list[tuple[int, int]]:
    """Stretches from a surge to ``least`` up to the dive."""
    sums = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    runs: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        if not size[i] or sums[i] < least:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] > 0:  # until it dives
            j += 1
        runs.append((i, j))
        i = j
    return runs


def main_text(page: str | None) -> str:
    """The blocks of the article that is marked, or else those between surges and dives, joined by empty lines."""
    found = [(text, article, linked) for text, zone, article, linked in lines(page or "") if not zone]

    def lengths(rows: list[tuple[str, bool, int]]) -> list[int]:
        return [max(0, len(text) - linked) for text, _, linked in rows]

    def least(size: list[int]) -> int:
        return max(1, min(THRESHOLD, max((sum(size[i : i + WINDOW]) for i in range(len(size))), default=0)))

    inside = [row for row in found if row[1]]
    if inside:
        size = lengths(inside)
        outside = lengths([row for row in found if not row[1]])
        largest = max((sum(outside[i:j]) for i, j in _runs(outside, THRESHOLD)), default=0)
        if largest <= (sum(size) or sum(len(text) for text, _, _ in inside)):  # an article of nothing but links is measured with them
            return "\n\n".join(text for text, _, _ in inside)
    size = lengths(found)
    keep = [k for i, j in _runs(size, least(size)) for k in range(i, j)]
    while keep and not size[keep[-1]]:  # lines of nothing but links stay inside the text, not at its end
        keep.pop()
    return "\n\n".join(found[k][0] for k in keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype="object")

    rows = pages.select(quoted(id_col), quoted(url_col), extracted(quoted(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
