"""The main body of crawled pages, by tree scoring.

A page is read into a tree whose leaves are blocks of text. A paragraph passes points for its length and its commas
to its ancestors, halved at each step and discounted by the share of link text; the block that repeats the page's title
passes a bonus. The container with most points is kept, with siblings of its own form that score alike. The lines of
the page's text are then aligned with the blocks. Inside the container, a line is left out if it is a prompt or a stamp.

Pages without usable HTML are read by their text alone: the body starts at the title, and each line after it is
judged by how often lines of its form lie inside the bodies of all pages that have HTML.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.session import cut_lineage

_TOKEN = re.compile(r"<!--.*?-->|<(script|style|head|noscript|template|svg)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|([^<]+)|<", re.S | re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_CLASS = re.compile(r"(?:class|id)\s*=\s*[\"']?([^\"'>]*)", re.I)
_SPACE = re.compile(r"\s+")

# Tags that hold no text of their own line, that end a line, and that contain others.
_VOID = {"br", "hr", "img", "meta", "input", "link", "wbr", "area", "base", "col", "source", "embed"}
_INLINE = {"a", "b", "i", "u", "em", "strong", "span", "small", "sup", "sub", "abbr", "code", "mark", "td", "th", "label", "cite", "q", "s", "time"}
_LEAF = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "option", "figcaption", "blockquote", "pre"}
_NAMED_AWAY = re.compile(r"\b(?:nav|menu|side-?bar|footer|site-footer|cookie|breadcrumb|social|share|comment|related|banner|advert|promo|top-menu|masthead)", re.I)
_NAMED_IN = re.compile(r"\b(?:article|main|content|entry|post-body|story|notice)", re.I)
_TAG_AWAY, _TAG_IN = {"nav", "aside", "footer", "header", "form"}, {"article", "main"}

# What a page says to its reader inside the body.
_PROMPT = re.compile(
    r"^\W*(?:(?:posted|published|updated|uploaded|last updated)\b.*(?:\bby\b|\bviews?\b|\breads?\b).*|print(?: this)?(?: page)?|share(?: this)?\b.{0,60}|join our\b.{0,80}"
    r"|(?:click|tap) here\b.{0,80}|rate this\b.{0,40}|subscribe\b.{0,60}|follow us\b.{0,60}|(?:also|read|see) (?:read|also|more)\b.{0,160}|you may also like.*|back to top|download (?:the|our) (?:mobile )?app\b.*"
    r"|\d[\d,]* (?:views?|comments?|shares?)|tags?:.*|filed under.*|comments? (?:are )?(?:closed|off).*|advertisement)\W*$", re.I)  # fmt: skip


def squeeze(text: str) -> str:
    return _SPACE.sub("", text)


class Node:
    __slots__ = ("tag", "name", "parent", "points", "own", "chars", "linked", "order")

    def __init__(self, tag: str, name: str, parent: "Node | None", order: int):
        self.tag, self.name, self.parent, self.order = tag, name, parent, order
        self.points, self.own, self.chars, self.linked = 0.0, 0, 0, 0


class Block:
    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


def read_page(page: str) -> tuple[str, list[Block], list[Node]]:
    """(title, blocks in page order, containers)."""
    m = _TITLE.search(page)
    title = html.unescape(m.group(1)).strip() if m else ""
    root = Node("body", "", None, 0)
    nodes, stack, blocks = [root], [root], []
    parts: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, min(linked, len(text)), stack[-1]))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        ending = m.group(2) == "/"
        if tag == "a":
            links = max(0, links + (-1 if ending else 1))
            continue
        if tag in ("td", "th"):
            # cells of one row share a line; a cell that lays the page out holds blocks of its own
            parts.append(" ")
            if not ending and m.group(4).strip():
                close()
            continue
        if tag in _INLINE or tag in ("html", "body"):
            continue
        close()
        links = 0 if tag not in _VOID else links
        if tag in _VOID or tag in _LEAF:
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        else:
            if len(stack) < 400:
                found = _CLASS.search(m.group(4))
                node = Node(tag, found.group(1).strip() if found else "", stack[-1], len(nodes))
                nodes.append(node)
                stack.append(node)
    close()
    return title, blocks, nodes


def score_tree(title: str, blocks: list[Block], nodes: list[Node]) -> list[Node]:
    """The containers that hold the main body, the best first."""
    heading = squeeze(title).lower()
    leaf_of: dict[int, Node] = {}
    for block in blocks:
        size = len(block.text)
        node = block.node
        # a container with one block is itself the paragraph
        depth = 1.0
        away = block.linked / size if size else 1.0
        points = 0.0
        if size >= 25:
            points = (1 + min(block.text.count(",") + block.text.count("،"), 10) + min(size / 100, 3)) * (1 - away)
        elif away < 0.5:
            points = 0.3
        if heading and squeeze(block.text).lower() == heading:
            points += 30
        at: Node | None = node
        at.own += 1
        while at is not None:
            at.points += points * depth
            at.chars += size
            at.linked += block.linked
            depth /= 2
            at = at.parent
        leaf_of[id(block)] = node
    parents = {id(n.parent) for n in nodes}
    only = {id(n) for n in nodes if n.own == 1 and id(n) not in parents}
    best, top = nodes[0], -1.0
    for node in nodes:
        if not node.chars or node.parent is None and len(nodes) > 1:
            continue
        points = node.points
        if id(node) in only and node.parent is not None and node.parent.parent is not None:
            continue
        away = bool(_NAMED_AWAY.search(node.name)) or node.tag in _TAG_AWAY
        kept = bool(_NAMED_IN.search(node.name)) or node.tag in _TAG_IN
        points *= (1 - node.linked / node.chars) * (0.3 if away and not kept else 1.25 if kept else 1.0)
        if points > top:
            best, top = node, points
    if top < 0:
        return [nodes[0]]
    chosen = [best]
    if best.name and best.parent is not None:
        for node in nodes:
            if node is not best and node.parent is best.parent and node.tag == best.tag and node.name == best.name and node.chars:
                if node.points * (1 - node.linked / node.chars) >= 0.5 * top and node.linked < 0.25 * node.chars:
                    chosen.append(node)
    return chosen


def _inside(node: Node | None, chosen: set[int]) -> bool:
    while node is not None:
        if id(node) in chosen:
            return True
        node = node.parent
    return False


def is_prompt(line: str) -> bool:
    return len(line) <= 300 and bool(_PROMPT.match(_SPACE.sub(" ", line).strip()))


def body_lines(text: str, page: str) -> list[bool] | None:
    """For each line of `text`, whether it is in the page's main body (prompts included); null if the page has no blocks."""
    title, blocks, nodes = read_page(page)
    if not blocks:
        return None
    chosen = {id(n) for n in score_tree(title, blocks, nodes)}
    marks = [_inside(b.node, chosen) for b in blocks]
    texts = [squeeze(b.text) for b in blocks]
    where: dict[str, list[int]] = {}
    for j, t in enumerate(texts):
        where.setdefault(t, []).append(j)
    # all blocks as one text, to look for lines that are part of a block
    whole = "\n".join(texts)
    starts = list(accumulate((len(t) + 1 for t in texts), initial=0))

    def equal(key: str, low: int, high: int) -> int | None:
        places = where.get(key, [])
        k = bisect_left(places, low)
        return places[k] if k < len(places) and places[k] < high else None

    def within(key: str, low: int, high: int) -> int | None:
        place = whole.find(key, starts[low], starts[high])
        return bisect_right(starts, place) - 1 if place >= 0 else None

    out, at, n = [], 0, len(blocks)
    passed = None
    last = False
    for line in text.split("\n"):
        key = squeeze(html.unescape(line))
        if not key:
            out.append(False)
            continue
        if at < n and texts[at] == key:
            last, at = marks[at], at + 1
        else:
            # blocks without a line, and lines without a block, are passed over; a near block goes before a far one
            near = min(n, at + 60)
            k = equal(key, at, near)
            if k is None and passed is not None:
                # a far block may have been the wrong one: its forerunners are still open
                k = equal(key, passed, at)
            part = None if k is not None else within(key, max(0, at - 1), near)
            if k is None and part is None:
                k = equal(key, near, n)
                part = None if k is not None else within(key, near, n)
                if k is not None or part is not None:
                    passed = at if passed is None else min(passed, at)
            if k is not None:
                last, at = marks[k], k + 1
            elif part is not None:
                last, at = marks[part], max(at, part)
        out.append(last)
    return out


_DIGITS = re.compile(r"\d+")


def line_form(line: str) -> str:
    """The form that lines of one make share: digits as 9, spaces squeezed; of more than 120 characters, the first 120, a hash of all and the last."""
    form = _DIGITS.sub("9", _SPACE.sub(" ", line).strip().lower())
    return form if len(form) <= 120 else f"{form[:120]}…{blake2b(form.encode(errors='surrogatepass'), digest_size=8).hexdigest()}{form[-1]}"


_FORMS = {"kind": pa.string(), "raw_item_id": pa.string(), "line_no": pa.int32(), "form": pa.string(), "inside": pa.int64(), "outside": pa.int64()}
_FORMS_SQL = "kind string, raw_item_id string, line_no int, form string, inside bigint, outside bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept lines (k) of pages with HTML, lines to judge (j) of pages without, counts of line forms (f)."""
    forms: dict[str, list[int]] = {}

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _FORMS.values())], names=list(_FORMS))

    def flush() -> Iterator[pa.RecordBatch]:
        if forms:
            yield emit([("f", None, None, k, a, b) for k, (a, b) in forms.items()])
            forms.clear()

    for batch in batches:
        rows: list[tuple] = []
        for item, text, page, title in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if text is None:
                continue
            lines = text.split("\n")
            marks = body_lines(text, page) if page else None
            if marks is not None:
                heading = squeeze(title or "")
                for n, (line, inside) in enumerate(zip(lines, marks), 1):
                    if line.strip():
                        c = forms.setdefault(line_form(line), [0, 0])
                        c[0 if inside else 1] += 1
                        if inside and (not is_prompt(line) or squeeze(line) == heading):
                            rows.append(("k", item, n, None, None, None))
            else:
                heading = squeeze(title or "").lower()
                start = next((n for n, line in enumerate(lines, 1) if heading and squeeze(line).lower() == heading), 0)
                for n, line in enumerate(lines, 1):
                    if line.strip() and n >= start:
                        # inside: 1 at the title, else 0; outside: 1 if the page shows no title
                        rows.append(("j", item, n, line_form(line), int(n == start), int(start == 0)))
        if rows:
            yield emit(rows)
        if len(forms) > 200_000:
            yield from flush()
    yield from flush()


def _judge(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pages:
        items, numbers = [], []
        for item, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ended = 0
            for line in sorted(lines, key=lambda x: x["line_no"]):
                inside, outside, form = line["inside"] or 0, line["outside"] or 0, line["form"]
                if line["start"]:
                    items.append(item)
                    numbers.append(line["line_no"])
                    continue
                if is_prompt(form):
                    continue
                share = inside / (inside + outside) if inside + outside else None
                prose = len(form) > 60 and form[-1] in ".।?…" and "»" not in form and ">" not in form
                away = share < 0.5 if share is not None and inside + outside >= 2 else not prose
                if away:
                    ended += 1
                elif ended < 1 or share is not None and share > 0.9 and inside >= 3:
                    items.append(item)
                    numbers.append(line["line_no"])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(numbers, pa.int32())], names=["raw_item_id", "line_no"])


def main_lines(pages: DataFrame) -> DataFrame:
    """(raw_item_id, line_no) of every line of raw_text, numbered from 1, that belongs to the page's main body.

    `pages` has id, raw_html, raw_text and title_raw; other columns are left out. A null raw_text gives no rows, a blank
    one neither. A null or unreadable raw_html leaves the text to be judged by its lines. Rows that repeat an id are read each, and
    equal lines given once.
    """
    rows = pages.select(F.col("id").cast("string").alias("id"), F.col("raw_text").cast("string").alias("raw_text"), F.col("raw_html").cast("string").alias("raw_html"), F.col("title_raw").cast("string").alias("title_raw"))
    scanned = cut_lineage(rows.where("raw_text is not null").mapInArrow(_scan, _FORMS_SQL))
    kept = scanned.where("kind = 'k'").select("raw_item_id", "line_no")
    judged = scanned.where("kind = 'j'").select("raw_item_id", "line_no", "form", (F.col("inside") == 1).alias("start"))
    asked = judged.select("form").distinct()
    forms = scanned.where("kind = 'f'").join(asked, "form", "left_semi").groupBy("form").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    lines = judged.join(forms, "form", "left").groupBy("raw_item_id").agg(F.collect_list(F.struct("line_no", "form", "start", "inside", "outside")).alias("lines"))
    return kept.unionByName(lines.mapInArrow(_judge, "raw_item_id string, line_no int")).distinct()


def main_text(pages: DataFrame) -> DataFrame:
    """(raw_item_id, main_text): the kept lines of each page, in order; pages without any are left out."""
    numbers = main_lines(pages).groupBy(F.col("raw_item_id").alias("id")).agg(F.collect_set("line_no").alias("numbers"))
    texts = pages.select(F.col("id").cast("string").alias("id"), "raw_text").where("raw_text is not null").dropDuplicates(["id"])
    lines = F.filter(F.transform(F.split("raw_text", "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: F.array_contains("numbers", s["i"]))
    return texts.join(numbers, "id").select(F.col("id").alias("raw_item_id"), F.array_join(F.transform(lines, lambda s: F.trim(s["x"])), "\n").alias("main_text"))
