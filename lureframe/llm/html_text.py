"""Main text of web pages by differencing with the pages of nearest URL.

A page is cut into lines of text, one per block element.  Pages of a host are
ordered by URL path; each page meets the nearest page before and after it that is not a
copy of it, their lines are aligned by longest common subsequence, and lines that both
have belong to the template and are deleted.  Lines in an element whose class or id names a
menu, an advert and the like align by that name, whatever they say, and an element goes
if one of its lines has a partner.  Plain paragraphs inside a declared article are protected,
since there an equal line is a quotation or a copy.

Mark-up decides without alignment in two cases only: elements that HTML itself defines as
navigation, footer, aside, form, dialog or head go always, and on a page without a
neighbour to compare with, named elements of short lines and what lies outside the article go.
"""
from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import if_small, row_keys, stored
from .tokens import slices_of
from .url_reputation import host_of, path_of

#: Kinds of lines: plain line of a declared article, line that differencing may delete, line of a named template slot, line of an
#: element that HTML defines as no article, line outside the declared article.
PLAIN, OPEN, SLOT, TAGGED, OUTSIDE = 0, 1, 2, 3, 4
#: A page of which a neighbour has more than this part of all text outside slots is a copy of it: it says nothing about the template.
COPY = 0.95
#: Pages back that are looked at for one that is no copy.
BACK = 8
#: Characters of a line, on average, from which a named element without any neighbour to tell is taken for text.
TEXT_LINE = 120

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
#: The same without regard to quotes, from the first tag on whose quotes do not close.
LOOSE_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption article main".split())
SLOT_TAGS = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "dialog": "notice", "head": "head"}
#: Words of class, id, role or label that mark a template slot.
SLOT_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager skip",
    "header": "masthead header topbar", "footer": "footer colophon copyright contentinfo",
    "sidebar": "sidebar aside rail widget widgets related recommended recommendations trending complementary",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay banner announcement paywall disclaimer",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "form": "newsletter subscribe subscription signup login search form",
    "comments": "comment comments disqus respond replies reply discussion", "share": "share sharing social",
}
SLOT_OF = {w: slot for slot, words in SLOT_WORDS.items() for w in words.split()}
#: Beside these words, "header" and the like name a part of the article.
ARTICLE_WORDS = frozenset("article post entry story content main body".split())


def slot_name(tag: str, attributes: str, inside: bool) -> str | None:
    """The template slot that an element opens; inside an article a header belongs to it."""
    if tag in SLOT_TAGS or tag == "header" and not inside:
        return f"<{SLOT_TAGS.get(tag, tag)}>"
    if not attributes or tag in ("main", "body", "html"):
        return None
    words = [w.lower() for a in ATTRIBUTE.findall(attributes) for w in TOKEN.findall(a)]
    if not words:
        return None
    own = not ARTICLE_WORDS.isdisjoint(words)
    for w in words:
        slot = SLOT_OF.get(w)
        if slot and not (own and slot in ("header", "footer", "notice", "form")) and not (inside and slot == "header"):
            return slot
    return None


def lines_of(page: str) -> list[tuple[str, int, str]]:
    """(text, kind, slot) of each line in page order; white space is one blank, empty lines are left out."""
    out: list[list] = []
    # tag, the slot it opens, has a name; then what holds inside it: slot, article
    stack: list[tuple[str, str | None, bool, str | None, bool]] = []
    count: dict[str, int] = {}
    held: list[str] = []
    slot, inside = None, False

    def flush():
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            held.clear()
            if text:
                top = next((t for t in reversed(stack) if t[0] in BLOCK), None)
                plain = inside and top is not None and (top[0] in TEXT_BLOCK or not top[2])
                out.append([text, (TAGGED if slot[0] == "<" else SLOT) if slot else PLAIN if plain else OPEN, slot or "", inside])

    def close_from(k):
        nonlocal slot, inside
        for t in stack[k:]:
            count[t[0]] -= 1
        del stack[k:]
        slot, inside = stack[-1][3:] if stack else (None, False)

    at, end, last, pattern = 0, len(page), page.rfind(">"), TAG
    while at < end:
        begin = page.find("<", at)
        if begin < 0 or begin > last and not page.startswith("<!--", begin):
            held.append(page[at:])
            break
        m = pattern.match(page, begin)
        if not m and pattern is TAG and page[begin + 1:begin + 2].isalpha():
            pattern = LOOSE_TAG
            m = pattern.match(page, begin)
        held.append(page[at:begin if m else begin + 1])
        at = m.end() if m else begin + 1
        if not m:
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            close = RAW[tag].search(page, at)
            at = close.end() if close else end
            held.append(" ")
            continue
        if tag == "br" or tag in VOID and tag in BLOCK:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        block = tag in BLOCK
        if block:
            flush()
        if m[1]:
            if count.get(tag):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                if not block and any(t[1] for t in stack[k:]):
                    flush()
                close_from(k)
            continue
        if block:  # an open paragraph, or an item of the same list, ends here
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" or t == tag == "li":
                    close_from(k)
                    break
                if t in BLOCK:
                    break
        mark = slot_name(tag, m[3], inside)
        if tag in ("article", "main") and not mark and (slot or "").strip("<>") in ("menu", "header", "advert", "notice"):
            # an article does not stand in a menu or advert: those were left open
            close_from(next(k for k, t in enumerate(stack) if t[1]))
        if mark and not block:
            flush()
        slot, inside = slot or mark, inside or tag in ("article", "main")
        stack.append((tag, mark, bool(m[3] and ATTRIBUTE.search(m[3])), slot, inside))
        count[tag] = count.get(tag, 0) + 1
    flush()
    # the article is declared if it holds most of the text outside slots: a teaser does not declare one
    text = [(line[3], len(line[0])) for line in out if line[1] in (PLAIN, OPEN)]
    declared = sum(n for within, n in text if within) >= max(1, sum(n for within, n in text if not within))
    return [(t, OUTSIDE if declared and not within and kind in (PLAIN, OPEN) else kind if declared or kind != PLAIN else OPEN, s) for t, kind, s, within in out]


def line_keys(lines: list[tuple[str, int, str]]) -> list[int]:
    """64-bit keys that align lines of two pages: a slot's name or the text, and which occurrence of it this is."""
    import xxhash

    seen: dict[str, int] = {}
    out = []
    for text, kind, slot in lines:
        name = "\0" + slot if kind in (SLOT, TAGGED) else text
        seen[name] = seen.get(name, 0) + 1
        out.append(xxhash.xxh64_intdigest(f"{seen[name]}\0{name}") - 2**63)
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence; keys are distinct within a page, so it is a longest rising run of matches."""
    where = {k: j for j, k in enumerate(b)}
    tails: list[int] = []
    ends: list[int] = []
    back: dict[int, int] = {}
    for i, k in enumerate(a):
        j = where.get(k)
        if j is None:
            continue
        at = bisect_left(tails, j)
        if at:
            back[i] = ends[at - 1]
        if at == len(tails):
            tails.append(j)
            ends.append(i)
        else:
            tails[at], ends[at] = j, i
    out = []
    i = ends[-1] if ends else None
    while i is not None:
        out.append(i)
        i = back.get(i)
    return out[::-1]


def shared_lines(a: dict, b: dict) -> list[int] | None:
    """Lines of page ``a`` that its neighbour ``b`` has at an aligned place, but for protected ones; None if ``b`` is a copy of it."""
    shared = common_lines(a["keys"], b["keys"])
    text = (PLAIN, OPEN, OUTSIDE)
    whole = sum(n for n, k in zip(a["sizes"], a["kinds"]) if k in text)
    if whole and sum(a["sizes"][i] for i in shared if a["kinds"][i] in text) > COPY * whole:
        return None
    return [i for i in shared if a["kinds"][i] != PLAIN]


def text_lines(lines: list[tuple[str, int, str]], aligned: set[int] | None) -> tuple[list[str], int, int]:
    """The lines that stay, and how many went because a neighbour has them and by mark-up alone; ``aligned`` is None without a neighbour."""
    kept, by_neighbour, by_markup, at = [], 0, 0, 0
    while at < len(lines):
        _, kind, slot = lines[at]
        end = at + 1
        if kind in (SLOT, TAGGED):  # the element as a whole
            while end < len(lines) and lines[end][1:] == (kind, slot):
                end += 1
        met = aligned is not None and not aligned.isdisjoint(range(at, end))
        alone = aligned is None and (kind == OUTSIDE or kind == SLOT and sum(len(x[0]) for x in lines[at:end]) < TEXT_LINE * (end - at))
        if met:
            by_neighbour += end - at
        elif kind == TAGGED or alone:
            by_markup += end - at
        else:
            kept += [x[0] for x in lines[at:end]]
        at = end
    return kept, by_neighbour, by_markup


def _line_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in (s for batch in batches for s in slices_of(batch, 512)):
        cols: tuple[list, ...] = ([], [], [])
        for page in b.column("html").to_pylist():
            lines = lines_of(page)
            for c, v in zip(cols, (line_keys(lines), [k for _, k, _ in lines], [len(t) for t, _, _ in lines])):
                c.append(v)
        arrays = [b.column(c) for c in ("k1", "k2", "host", "path")]
        arrays += [pa.array(c, pa.list_(k)) for c, k in zip(cols, (pa.int64(), pa.int8(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "host", "path", "keys", "kinds", "sizes"])


def _pairs(batches: Iterator, borders: bool) -> Iterator:
    """Deletions of neighbours in the order of the rows, and the first and last row of a partition for the pairs that span two.

    Without ``borders`` the rows are those first (side 0) and last ones (side 1): only a last and the next first are neighbours.
    """
    import pyarrow as pa

    names = ["k1", "k2", "host", "path", "keys", "kinds", "sizes"]
    dels: list = []
    before, first = None, None
    recent: list = []  # the last pages of the host, each with whether it has met a later one
    edge: list = []

    def out(rows, kept):
        kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("gone", pa.list_(pa.int32())), ("host", pa.string()), ("path", pa.string()),
                          ("keys", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8())), ("sizes", pa.list_(pa.int32())), ("side", pa.int32())])
        data = [{"k1": k1, "k2": k2, "gone": g} for k1, k2, g in rows] + [{**r, "side": side} for side, r in kept]
        return pa.RecordBatch.from_pylist(data, schema=kind)

    for b in batches:
        for row in b.select(names if borders else [*names, "side"]).to_pylist():
            if before is None:
                first = row
            if before is not None and before["host"] != row["host"] or not borders and (before is None or (before["side"], row["side"]) != (1, 0)):
                recent = []
            found = False  # a page before this one that is no copy of it
            for seen in reversed(recent):
                if found and seen[1]:
                    continue
                x = seen[0]
                for mine, other in ((row, x),) * (not found) + ((x, row),) * (not seen[1]):
                    gone = shared_lines(mine, other)
                    if gone is not None:
                        dels.append((mine["k1"], mine["k2"], gone))
                        if mine is row:
                            found = True
                        else:
                            seen[1] = True
            recent = [*recent[1 - BACK:], [row, False]]
            before = row
            if len(dels) > 2000:
                yield out(dels, [])
                dels = []
    if borders and first is not None:
        edge = [(0, first), (1, before)]
    if dels or edge:
        yield out(dels, edge)


_PAIR_ROWS = ("k1 long, k2 long, gone array<int>, host string, path string, keys array<long>, kinds array<byte>, sizes array<int>, side int")


def template_lines(pages: DataFrame, url: str = "url") -> DataFrame:
    """k1, k2 and gone (numbers of the lines that a neighbour has too) of the pages (k1, k2, url, html) that have a neighbour to compare with.

    Pages are dealt by ranges of (host, path), so a host with a third of all pages spreads; only line hashes move.  The pairs
    that span two ranges come from the two border rows of each range.
    """
    light = pages.select("k1", "k2", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), "html").mapInArrow(
        _line_rows, "k1 long, k2 long, host string, path string, keys array<long>, kinds array<byte>, sizes array<int>")
    light = stored(light, "lines")
    order = ["host", "path", "k1", "k2"]
    ranged = light.repartitionByRange(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(lambda it: _pairs(it, True), _PAIR_ROWS), "pairs")
    # two rows of each range: sorted again they stand as first, last, first, last; only last-first pairs are neighbours
    borders = found.where("side is not null").select("host", "path", "k1", "k2", "keys", "kinds", "sizes", "side")
    spanning = borders.repartition(1).sortWithinPartitions(*order, "side").mapInArrow(lambda it: _pairs(it, False), _PAIR_ROWS)
    gone = found.where("side is null").unionByName(spanning)
    return gone.groupBy("k1", "k2").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))  # two neighbours a page


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (lines deleted because a neighbour has them), n_markup (by mark-up alone) of every page row.

    The text is what remains when the template is gone: character references decoded, white space in a block one blank, blocks joined
    by a line feed.  Null or empty html: empty text.  Null urls are one host without a name.  Very long pages are read in linear
    time.  Rows that repeat give equal results; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.select(*row_keys("page_id", "url", "html"), "page_id", "url", "html")
    gone = stored(template_lines(keyed.select("k1", "k2", "url", "html")), "gone")
    joined = keyed.join(if_small(gone), ["k1", "k2"], "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (s for batch in batches for s in slices_of(batch, 512)):
            texts, counts = [], ([], [])
            for page, drop in zip(b.column("html").to_pylist(), b.column("gone").to_pylist()):
                kept, *numbers = text_lines(lines_of(page), None if drop is None else set(drop))
                texts.append("\n".join(kept))
                for c, n in zip(counts, numbers):
                    c.append(n)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                                              *[pa.array(c, pa.int64()) for c in counts]], names=["page_id", "url", "text", "n_chars", "n_template", "n_markup"])

    kinds = dict(rows.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_template long, n_markup long")
