"""Main text of web pages by consensus of the pages of a host.

Each page scores its containers by the text they hold outside links and page
furniture, and votes for the path of the best one: tags with their first class,
digits made equal. Spark counts the votes of each host; paths with a fair share
of them win. Pages are then extracted again from the best container on a winning
path, or on the page's own best path where it has none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.base import Scratch, query, sized, table
from veritab.llm.words import small_batches

WINNING_SHARE = 0.1
LEVEL_SHARE = 0.8

# Element names of the HTML standard by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
CONTAINERS = set("article blockquote body center details div dl figure main ol section table tbody td tr ul".split())
FURNITURE = set(
    "aside button datalist dialog footer form head header iframe menu nav noscript object option select svg template "
    "textarea title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id or role that mark furniture.
MARKS = set(
    "ad ads advert advertisement adverts adv banner breadcrumb breadcrumbs byline comment comments commentlist consent "
    "contentinfo cookie cookies disclaimer disqus dropdown footer form gdpr header legal masthead menu menubar modal "
    "nav navbar navigation newsletter notice notification overlay pager pagination popup popular promo promoted "
    "recommended related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|/)", re.I)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z]+")


class Container:
    __slots__ = ("path", "parent", "blocks", "own", "score", "order")

    def __init__(self, path: str, parent: "Container | None", order: int):
        self.path, self.parent, self.order = path, parent, order
        self.blocks: list[tuple[int, str]] = []
        self.own = 0.0
        self.score = 0.0


def _described(tag: str, rest: str) -> tuple[str, bool]:
    """Path step of an element and whether it is page furniture."""
    furniture = tag in FURNITURE
    step = tag
    if rest and "=" in rest:
        names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        marks = " ".join(names.get(k, "") for k in ("class", "id", "role")).lower()
        if marks.strip():
            own = names.get("class", "").split()
            if own:
                step = f"{tag}.{_DIGITS.sub('#', own[0].lower())}"
            if tag not in ("html", "body", "article", "main") and not MARKS.isdisjoint(_SPLIT.split(marks)):
                furniture = True
        style = names.get("style", "").replace(" ", "").lower()
        if "display:none" in style or "visibility:hidden" in style or names.get("aria-hidden", "").lower() == "true":
            furniture = True
        rest = _ATTRIBUTE.sub(" ", rest)
    if rest and _BARE_HIDDEN.search(rest):
        furniture = True
    return step, furniture


def containers(html: str) -> list[Container]:
    """All containers of a page with their blocks of text in page order and their scores."""
    root = Container("", None, 0)
    found = [root]
    stack: list[tuple[str, Container, bool, bool]] = [("", root, False, False)]
    text: list[str] = []
    linked = 0
    number = 0

    def flush(container: Container) -> None:
        nonlocal text, linked, number
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                container.blocks.append((number, joined))
                number += 1
                container.own += max(0, len(joined) - 2 * linked)
        text, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        _, _, furniture, link = stack[-1]
        if raw and not furniture:
            plain = unescape(raw) if "&" in raw else raw
            text.append(plain)
            if link:
                linked += len(plain)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[2]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
            if depth:
                if any(s[0] in BLOCKS for s in stack[depth:]):
                    flush(stack[-1][1])
                del stack[depth:]
            elif tag in BLOCKS:
                flush(stack[-1][1])
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush(stack[-1][1])
            continue
        ends = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        if ends:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in ends:
                    flush(stack[-1][1])
                    del stack[d:]
                    break
                if stack[d][0] in CONTAINERS:
                    break
        _, container, furniture, link = stack[-1]
        if tag in BLOCKS:
            flush(container)
        step, drops = _described(tag, m[4])
        if tag in CONTAINERS and not furniture and not drops:
            container = Container(f"{container.path}>{step}", container, number)
            found.append(container)
        if not m[4].endswith("/"):
            stack.append((tag, container, furniture or drops, link or tag == "a"))
    say(html[at:])
    flush(stack[-1][1])
    for c in reversed(found):
        c.score += c.own
        if c.parent is not None:
            c.parent.score += LEVEL_SHARE * c.score
    return found


def best_path(found: list[Container]) -> str:
    return max(found, key=lambda c: (c.score, -c.order)).path


def text_of(found: list[Container], chosen: str) -> str:
    """Text of all containers on a path, with everything inside them, one block a line."""
    inside: set[int] = set()
    blocks: list[tuple[int, str]] = []
    for c in found:  # parents come first
        if c.path == chosen or (c.parent is not None and id(c.parent) in inside):
            inside.add(id(c))
            blocks += c.blocks
    return "\n".join(t for _, t in sorted(blocks))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html"):
        paths = [best_path(containers(h or "")) for h in batch.column("html").to_pylist()]
        yield pa.record_batch({"host": batch.column("host"), "path": pa.array(paths, pa.string())})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html"):
        texts = []
        for html, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist()):
            found = containers(html or "")
            winning = [c for c in found if c.path in set(paths or ()) and c.score > 0]
            texts.append(text_of(found, best_path(winning or found)))
        yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"),
                               "text": pa.array(texts, pa.string())})


def host_of(url: str):
    """The part of a url column between ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    ``text`` is the main text of the whole html: blocks in page order, white space
    inside a block made one space, joined by a line feed; NULL or empty html gives
    an empty text. Rows without a url form a host of their own. Repeated rows are
    extracted each; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    source = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"),
                          pages["html"].cast("string").alias("html")).withColumn("host", host_of("url"))
    votes = source.select("host", "html").mapInArrow(_votes, "host string, path string").groupBy("host", "path").count()
    votes = scratch.write(votes)
    totals = votes.groupBy("host").agg(F.sum("count").alias("all"))
    # At most 1 / WINNING_SHARE paths win in a host.
    winners = scratch.write(
        votes.join(totals, "host").filter(F.col("count") >= F.col("all") * WINNING_SHARE).groupBy("host").agg(
            F.sort_array(F.collect_list("path")).alias("paths")))
    asked = source.join(sized(winners, winners.count()), "host", "left").select("page_id", "url", "html", "paths")
    kind = source.schema["page_id"].dataType.simpleString()
    return asked.mapInArrow(_extract, f"page_id {kind}, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long"))


@query("op6_main_texts")
def _main_texts(spark, folder):
    return main_texts(table(spark, folder, "pages"))
