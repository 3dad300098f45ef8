"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements; each carries its text, the share of it that stands in
links, the density of stop words, and what encloses it. The first pass decides blocks on their own:
what stands in a menu, header, footer, sidebar, notice, advert, form or comment (by element, role,
class or id) is boilerplate, as are blocks mostly of links and short copyright lines; long blocks with enough
stop words are text. Short blocks, and long ones without stop words, stay open. The second pass
labels those by their nearest decided neighbours, first in the same article and then on the page.

Every page is one row of a map over Arrow batches: nothing is shuffled, and a task holds a batch of pages.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Characters of a block that is decided by stop words of at least DENSE, and of a longer one of at least SPARSE.
SHORT, DENSE = 60, 0.18
LONG, SPARSE = 160, 0.08
#: Share of link characters above which a block is boilerplate, and above which it takes no good label in doubt.
LINKED, LINKISH = 0.5, 0.2

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in is it that for was on are as with his they at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up about out
der die das und ist von zu den nicht ein eine mit sich auf für dem des im auch als an es so wie werden aus er hat dass sie nach bei einer um am sind noch einem über nur oder war aber vor zur bis mehr durch
le la les de des et un une du en est que qui dans pour pas au sur ne se ce il elle avec plus par son sa mais comme ou nous vous ils leur cette être aux ont sont été
el los las y del se por con no una su para es al lo como más pero sus ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante
""".split())

# Elements that end a block, those whose content is no text at all, and those that are boilerplate.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog noscript template button select svg canvas object audio video head".split())
BOILERPLATE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist banner".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALONE = frozenset("li td th tr dt dd option p".split())
# Words of classes and ids.
BOILERPLATE_WORDS = frozenset("""
ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu submenu nav navbar navigation breadcrumb breadcrumbs sidebar footer copyright disclaimer cookie cookies consent gdpr
notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search comment comments disqus replies respond share sharing social related recommended widget widgets pager pagination toolbar skip hidden
""".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
TEXT_WORDS = frozenset("article articlebody story post entry content maincontent main prose".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,65536}\"|'[^']{0,65536}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def cues(name: str, attributes: str, in_text: bool) -> tuple[bool, bool]:
    """(boilerplate, article) as an element's name, role, class and id tell it; ``in_text`` says that it stands in an article."""
    boilerplate = name in BOILERPLATE or name == "header" and not in_text
    text = name in ("article", "main")
    if not attributes.strip():
        return boilerplate, text
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    words: set[str] = set()
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PART.findall(one)]
        if parts and parts[0] not in ("with", "has", "no", "without"):
            words |= {*parts, "".join(parts)}
    text = text or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or bool(words & TEXT_WORDS)
    if name in ("html", "body", "main"):
        return bool(hidden), text and name == "main"
    marked = words & BOILERPLATE_WORDS or words & HEADER_WORDS and not in_text and name not in ("article", "h1")
    return bool(boilerplate or role in BOILERPLATE_ROLES or hidden or marked), text


def blocks(page: str) -> list[tuple[str, float, bool, bool, int]]:
    """(text, share in links, heading, boilerplate by what encloses it, number of the article or 0) of each block with text."""
    out: list[tuple[str, float, bool, bool, int]] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    pieces: list[str] = []
    linked: list[str] = []
    link_depth, articles, at = 0, 0, 0

    def told(text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if link_depth:
                linked.append(text)

    def ended() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            share = len(" ".join("".join(linked).split())) / len(text)
            out.append((text, share, re.fullmatch("h[1-6]", stack[-1][0]) is not None, stack[-1][1], stack[-1][2]))
        pieces.clear()
        linked.clear()

    while True:
        tag = TAG.search(page, at)
        told(page[at : tag.start()] if tag else page[at:])
        if tag is None:
            break
        at = tag.end()
        close, name, attributes = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            link_depth = 0 if close else len(stack)
        elif close:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if name in BLOCKS or depth:
                ended()
            if depth:
                del stack[depth:]
        else:
            if name in BLOCKS:
                ended()
                if stack[-1][0] in ("p", name) and stack[-1][0] in ALONE:
                    stack.pop()
            boilerplate, text = cues(name, attributes, stack[-1][2] > 0)
            if name in RAW:
                end = RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            elif name not in VOID and (name in BLOCKS or boilerplate):
                if boilerplate:
                    ended()
                articles += text
                stack.append((name, boilerplate or stack[-1][1], articles if text else stack[-1][2]))
        if link_depth > len(stack):
            link_depth = 0
    ended()
    return out


def decided(text: str, share: float, boilerplate: bool) -> bool | None:
    """First pass: True for text, False for boilerplate, None for what the neighbours have to tell."""
    if boilerplate or share > LINKED or len(text) < LONG and text.lower().startswith(("©", "(c)", "copyright")):
        return False
    if len(text) < SHORT or share > LINKISH:
        return None
    words = WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return True if density >= (SPARSE if len(text) >= LONG else DENSE) else None


def labels(page: list[tuple[str, float, bool, bool, int]]) -> list[bool]:
    """Second pass: whether each block is text.

    An open block takes the label of the nearest decided block of its article; of two as near, a heading
    takes the later one's and others the good one unless links are in doubt. An article counts as good where none of its
    blocks is decided. Outside of articles an end of the page counts as boilerplate, unless marked boilerplate
    stands there already or nothing on the page is decided. What an element marks as boilerplate tells nothing about its neighbours.
    """
    first = [decided(t, share, marked) for t, share, _, marked, _ in page]
    told = [None if marked else label for label, (_, _, _, marked, _) in zip(first, page, strict=True)]
    out: list[bool] = []
    any_told = any(x is not None for x in told)
    marks = [k for k, (_, _, _, marked, _) in enumerate(page) if marked] or [len(page), -1]
    before, after = nearest(told, [b[4] for b in page]), nearest(told[::-1], [b[4] for b in page[::-1]])[::-1]
    for k, (label, (_, share, heading, _, article)) in enumerate(zip(first, page, strict=True)):
        if label is not None:
            out.append(label)
            continue
        near = [x for x in (before[k], after[k]) if x is not None]
        if article:
            near = near or [(1, True)]
        elif any_told:
            ends = (k + 1, False) if marks[0] > k else None, (len(page) - k, False) if marks[-1] < k else None
            near = [x for x in (before[k] or ends[0], after[k] or ends[1]) if x is not None] or [(1, True)]
        else:
            near = [(1, True)]
        least = min(d for d, _ in near)
        tied = [x for d, x in near if d == least]
        out.append(tied[-1] if heading else any(tied) and (all(tied) or article > 0 and share <= LINKISH))
    return out


def nearest(told: list[bool | None], articles: list[int]) -> list[tuple[int, bool] | None]:
    """(distance, label) of the last decided block of the same article before each block; distance counts blocks of the page."""
    last: dict[int, tuple[int, bool]] = {}
    out: list[tuple[int, bool] | None] = []
    for k, (label, article) in enumerate(zip(told, articles, strict=True)):
        out.append((k - last[article][0], last[article][1]) if article in last else None)
        if label is not None:
            last[article] = (k, label)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, good in zip(found, labels(found), strict=True) if good)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of it) for each row of ``pages`` (page_id, url, html).

    A null or empty html, and a page that is boilerplate alone, has an empty text. Null ids and urls stay, repeated
    rows stay and are equal, pages of any length are read whole, an empty table gives an empty one;
    other columns are not read, whatever their names.
    """
    scratch.small_batches(pages.sparkSession, 500)

    def by_batch(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(by_batch, "page_id long, url string, text string, n_chars long")


def op12_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
