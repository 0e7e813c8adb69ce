"""Main text of HTML by line-block distribution.

Markup is stripped to lines: every block-level element, and every ``br``-free run of text, is one
line. The weighted text lengths of WINDOW neighbouring lines are summed. Text regions begin where the
sums surge above the threshold and end where they dive below it. Short lines between two regions are
text as well, and so are those next to a region up to a line without weight, or in ``article`` and ``main``
also those behind it. Link lines between two text lines of ``article`` or ``main`` are text.

Lines of mostly link text weigh nothing, nor do those of elements that say by tag, role, class or id
that they are menus, headers, footers, sidebars, notices, adverts, forms or comments. Such a mark is
passed over on a wrapper, an element that holds most of the page's unlinked text (MOST; of elements
whose whole name is a mark, like ``footer``, NEARLY_ALL). Where a page has an ``article`` or ``main``
element, lines in it weigh CONTENT_WEIGHT times their length and the others that part of it; windows
do not reach over its border. Where the lines in it have weight but no surge they are the text; a page
without it and without surge is all text.

Null and empty pages give an empty text. Unclosed tags, stray ``<`` and cut pages are read as far as
they go. Repeated rows each get their row. The whole page is read, nothing is cut.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE_CHARS = 80  # sum over a window that starts a text region
LINK_SHARE = 0.6  # lines of mostly link text count as empty
CONTENT_WEIGHT = 4  # of lines in article or main; others are divided by it
MOST = 0.5  # share of the unlinked text that makes an element with a mark a wrapper
NEARLY_ALL = 0.9  # the same for an element whose name is a mark as a whole

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>?", re.S)
SILENT = frozenset("script style noscript template svg math canvas iframe object select textarea head title button".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
CONTENT = frozenset(["article", "main"])
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|alert|popup|modal|newsletter|subscri\w*|"
    r"nav|navbar|navigation|menu|breadcrumbs?|topbar|sidebar|side|widget\w*|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|discussion|disqus|replies|reviews?|header|masthead|footer|foot|copyright|pagination|pager|login|signup|search|form)(?:$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|discussion|disqus|replies|reviews?)(?:$|[_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
SPACE = re.compile(r"\s+")
BORDER = frozenset(["body", "table", "article", "main"])  # end tags of inline elements, p and li do not reach over it
MARKED = 2.0  # instead of the share of link text, which is 1 at most


def _mark(tag: str, attributes: str) -> float | None:
    """The share of the text above which the element is a wrapper in spite of its mark; None without a mark."""
    share = MOST if tag == "form" else NEARLY_ALL if tag in BOILERPLATE else None
    if not attributes or tag in ("html", "body", "article", "main"):
        return share
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name in ("class", "id"):
            marked = [x for x in value.split() if MARKS.search(x)]
            if marked:
                # has-sidebar or main-form may name a layout, sidebar or cookie-notice may not
                whole = any(COMMENTS.search(x) or all(MARKS.search(y) for y in re.split("[_-]+", x) if y) for x in marked)
                share = NEARLY_ALL if whole else share or MOST
        elif (name == "role" and value.lower() in ROLES) or (name in ("hidden", "aria-hidden") and value.lower() == "true"):
            share = NEARLY_ALL
    return share


def lines_of(page: str) -> list[tuple[str, float, bool]]:
    """(text, share of link text, inside article or main) of each line of the page.

    The share is MARKED on lines of elements that the page marks as something else than text.
    """
    # pieces (text, in a link, innermost mark or -1) of each line, and whether it is inside article or main
    raw: list[tuple[list[tuple[str, bool, int]], bool]] = []
    held: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements, whether they are silent, their mark
    places: dict[str, list[int]] = defaultdict(list)  # of each name in the stack
    borders: list[int] = []  # places of BORDER elements
    blocks: list[int] = []  # places of elements that are not inline
    marks: list[tuple[float, bool, int]] = []  # share that makes a wrapper, inside article or main, the mark around it
    inner = -1  # the innermost open mark
    holds_content: set[int] = set()
    dropped = content = links = 0
    at = 0

    def close_line() -> None:
        if held:
            raw.append((held[:], content > 0))
            held.clear()

    def pop() -> None:
        nonlocal dropped, content, links, inner
        tag, silent, mark = stack.pop()
        places[tag].pop()
        if tag in BORDER:
            borders.pop()
        if tag not in INLINE:
            blocks.pop()
        dropped -= silent
        content -= tag in CONTENT
        links -= tag == "a"
        if mark >= 0:
            inner = marks[mark][2]

    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not dropped:
            held.append((text, links > 0, inner))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or ""
        if tag == "br" and not dropped:
            held.append((" ", False, inner))
        if tag in VOID:
            continue
        if tag not in INLINE and not dropped:
            close_line()
        if closing:
            at_place = places[tag][-1] if places[tag] else len(stack)
            if not (tag in INLINE | {"p", "li"} and borders and borders[-1] > at_place):
                while len(stack) > at_place:
                    pop()
            continue
        if blocks and stack[blocks[-1]][0] in SELF_CLOSING.get(tag, ()):
            for _ in range(len(stack) - blocks[-1]):
                pop()
        silent = tag in SILENT
        if attributes.rstrip().endswith("/") and not silent:
            continue
        if silent and tag not in ("head", "svg", "math", "object", "select", "button"):
            # raw text: up to the closing tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        share, mark = None if silent or dropped else _mark(tag, attributes), -1
        if share is not None:
            mark = len(marks)
            marks.append((share, content > 0, inner))
            inner = mark
        places[tag].append(len(stack))
        if tag in BORDER:
            borders.append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, silent, mark))
        dropped += silent
        if tag in CONTENT and not dropped:
            holds_content.add(inner)
        content += tag in CONTENT
        links += tag == "a"
    close_line()

    lines = [(_pieces(pieces), inside) for pieces, inside in raw]
    total, in_content = 0, 0
    held_by = [0] * len(marks)
    for pieces, inside in lines:
        for text, linked, of in pieces:
            n = 0 if linked else len(text) - text.count(" ")
            total += n
            in_content += n if inside else 0
            if of >= 0:
                held_by[of] += n
    # a mark comes after those around it
    for k in range(len(marks) - 1, -1, -1):
        around = marks[k][2]
        if around >= 0:
            held_by[around] += held_by[k]
            if k in holds_content:
                holds_content.add(around)
    any_content = any(inside for _, inside in lines)
    marked: set[int] = set()
    for k, (share, inside, around) in enumerate(marks):
        if any_content and not inside and k not in holds_content:
            wrapper = False  # the page says that its text is elsewhere
        else:
            # inside article or main a mark is an exception that the page makes
            wrapper = held_by[k] > (NEARLY_ALL * in_content if inside else share * total)
        if not wrapper or around in marked:
            marked.add(k)

    out: list[tuple[str, float, bool]] = []
    for pieces, inside in lines:
        text_of = [p for p in pieces if p[2] not in marked]
        text = "".join(p[0] for p in text_of).strip()
        if text:
            text = SPACE.sub(" ", text)
            linked = sum(len(p[0]) for p in text_of if p[1])
            out.append((text, min(1.0, linked / len(text)), inside))
        elif other := SPACE.sub(" ", "".join(p[0] for p in pieces)).strip():
            out.append((other, MARKED, inside))
    return out


def _pieces(pieces: list[tuple[str, bool, int]]) -> list[tuple[str, bool, int]]:
    """Neighbours of one kind joined, entities read and white space made single."""
    out: list[tuple[str, bool, int]] = []
    for (linked, of), group in groupby(pieces, key=lambda p: p[1:]):
        out.append((SPACE.sub(" ", entities.unescape("".join(p[0] for p in group))), linked, of))
    return out


def region(lines: list[tuple[str, float, bool]], window: int = WINDOW, surge: int = SURGE_CHARS) -> list[str]:
    """The lines between surge and dive points."""
    tagged = any(inside for _, _, inside in lines)
    weight = {True: CONTENT_WEIGHT, False: 1 / CONTENT_WEIGHT if tagged else 1}
    size = [0 if link > LINK_SHARE else len(text) * weight[inside] for text, link, inside in lines]
    half, n = window // 2, len(lines)
    sums = [sum(size[k] for k in range(max(0, i - half), min(n, i + half + 1)) if lines[k][2] == lines[i][2]) for i in range(n)]
    tagged_size = any(x and line[2] for x, line in zip(size, lines, strict=True))
    ranked = [s for s, line in zip(sums, lines, strict=True) if line[2] == tagged_size]
    if max(ranked, default=0) < surge and (tagged_size or max(sums, default=0) < surge):
        # all lines are short: there is no surge
        text = [x > 0 and line[2] == tagged_size for x, line in zip(size, lines, strict=True)]
    else:
        text = [s >= surge and x > 0 for s, x in zip(sums, size, strict=True)]
        # short neighbours of a region up to a line without weight (inside the content also behind it) or its border
        for order in (range(n), range(n - 1, -1, -1)):
            run, side = False, None
            for i in order:
                inside = lines[i][2]
                run = run and inside == side and (inside or size[i] > 0)
                text[i] = text[i] or (run and size[i] > 0)
                run, side = run or text[i], inside
    # short lines between two regions on one side of the border, and links between text lines of the content
    at = [i for i in range(n) if text[i]]
    for a, b in zip(at, at[1:], strict=False):
        if all(lines[k][2] == lines[a][2] for k in range(a + 1, b + 1)):
            for k in range(a + 1, b):
                text[k] = size[k] > 0 or (lines[k][2] and lines[k][1] < MARKED)
    return [line[0] for line, is_text in zip(lines, text, strict=True) if is_text]


def main_text(page: str | None) -> str:
    return " ".join(region(lines_of(page or "")))


def _extract_batches(batches, window: int, surge: int):
    for batch in batches:
        texts = [" ".join(region(lines_of(p or ""), window, surge)) for p in batch.column(batch.num_columns - 1).to_pylist()]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"]
        )


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", window: int = WINDOW, surge: int = SURGE_CHARS) -> DataFrame:
    """``columns`` of each page with text and n_chars."""
    work = pages.select(*[F.col(f"`{c}`") for c in columns], F.col(html_col).alias("_html"))
    schema = work.drop("_html").schema.add("text", "string").add("n_chars", "long")
    return work.mapInArrow(partial(_extract_batches, window=window, surge=surge), schema)
