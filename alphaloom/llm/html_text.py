"""Main text of web pages by tag-path ratios.

A page is walked once into text nodes, each with the path of block tags from the root (inline tags
belong to their block). Nodes of one path are taken together: their text's length and its punctuation, each
as a ratio to the number of nodes, and the share of their text that is in links, which counts for nothing.
Along the page the first two ratios are smoothed: a node takes part in its neighbours' the more, the more of
their paths they share, so a title beside its article's paragraphs gains and a menu there does not. They are
fused into one score a path, less the share of links.

Paths at or above a threshold (the page's weighted mean less a part of the deviation) are content; the
smallest element that holds nearly all of their text, or the article or main element around it, is the page's
content element; with a title beside it, the element around both is. The text is that of all nodes whose path's score, times a
prior, reaches the threshold. The prior is one outside the content element, whatever the tag, so that a paragraph of a
block beside the article needs an article's score; it is ``LIKELY`` inside, and for headings and paragraphs that
are in no block with a class or id but those around it; and it is zero where the markup says what is never content: navigation, header, footer, asides, forms,
adverts, notices, comments. Class names of boilerplate are such markup too, but not of an element that holds most of the content.

Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# HTML elements by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "nav", "aside", "body", "html", "button", "td", "th"}
NEVER = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog"}
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
# Parts of class names and ids. Names of nothing else but such parts, one of them of boilerplate, are
# boilerplate; the FIRM ones whatever the element holds.
FIRM = set("ad ads advert adverts advertisement advertising cookie cookies consent gdpr newsletter subscribe nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus replies footer copyright pagination pager login signup".split())
BOILERPLATE = FIRM | set("sponsor sponsored promo promos promotion promotions banner notice alert popup modal overlay menu sidebar side widget related recommended share sharing social header masthead search toolbar".split())
BESIDE = set("site main page post posts article articles story stories content top bottom left right primary secondary global mobile box block list area section container wrapper wrap inner bar link links item items button buttons icon icons form text widgets".split())
#: Elements whose text is prose by its markup.
PROSE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption"}
#: The prior of paths in the content element. A score grows with the square of a node's length, so a title needs that
#: much beside a text of one long node; a path of links has no score, and fails with any prior.
LIKELY = 1e6
#: Comments, declarations and tags; a quotation mark quotes only after an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])\s*(?:=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？¿¡]")


@dataclass
class Node:
    """A text node: its text, its path of block tags (-1 for mere white space), its element, its block, and whether it is in a link."""

    text: str
    path: int
    element: int
    block: int
    link: bool


@dataclass
class Page:
    """Text nodes, and by number the elements (0 is the page; a parent has a smaller number) and the paths of block tags."""

    nodes: list[Node]
    parent: list[int]
    tag: list[str]
    never: list[bool]
    #: Boilerplate by a class name or id alone.
    named: list[bool]
    #: With a class or an id.
    labelled: list[bool]
    path_parent: list[int]
    path_depth: list[int]

    def down(self, own: list[bool]) -> list[bool]:
        """Whether own holds for an element or one around it."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def held(self, nodes: list[Node]) -> list[int]:
        """Characters of the nodes within each element."""
        out = [0] * len(self.parent)
        for n in nodes:
            out[n.element] += len(n.text)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def shared(self, a: int, b: int) -> float:
        """The share of two paths that is common to both, from the root."""
        total = self.path_depth[a] + self.path_depth[b]
        while a != b:
            if self.path_depth[a] >= self.path_depth[b]:
                a = self.path_parent[a]
            else:
                b = self.path_parent[b]
        return 2 * self.path_depth[a] / total if total else 1.0


def never_name(value: str) -> tuple[bool, bool]:
    """Whether one of the names in a class or id is one of boilerplate, and whether one is so firmly."""
    named = firm = False
    for name in value.lower().split():
        parts = [p for p in re.split("[_-]+", name) if p and not p.isdigit()]
        if any(p in BOILERPLATE for p in parts) and all(p in BOILERPLATE or p in BESIDE for p in parts):
            named, firm = True, firm or any(p in FIRM for p in parts)
    return named, firm


def parse(page: str) -> Page:
    """The text nodes of a page in order, as browsers nest them in the cases that matter here."""
    out = Page([], [0], [""], [False], [False], [False], [0], [0])
    paths: dict[tuple[int, str], int] = {}
    # An open element: tag, number, path of block tags, links around it and itself (headings' links are text).
    stack: list[tuple[str, int, int, bool]] = []
    opened: dict[str, int] = {}
    block = at = 0
    lower = None

    def add(raw: str) -> None:
        _, element, path, link = stack[-1] if stack else ("", 0, 0, False)
        if raw and not raw.isspace():
            out.nodes.append(Node(html.unescape(raw) if "&" in raw else raw, path, element, block, link))
        elif raw and out.nodes:
            out.nodes.append(Node(" ", -1, element, block, link))

    def close_to(depth: int) -> None:
        nonlocal block
        if any(s[0] not in INLINE for s in stack[depth:]):
            block += 1
        for s in stack[depth:]:
            opened[s[0]] -= 1
        del stack[depth:]

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if opened.get(tag) else -1
            # an inline end tag does not end blocks around it
            if depth >= 0 and not (tag in INLINE and any(s[0] not in INLINE for s in stack[depth + 1 :])):
                close_to(depth)
            elif depth < 0 and tag in CLOSES_P:
                block += 1
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else (e.start() if (e := re.compile(f"</{tag}", re.I).search(page, at)) else -1)
                at = len(page) if end < 0 else end
                tail = page.find(">", at)
                at = len(page) if tail < 0 or end < 0 else tail + 1
            continue
        if tag in CLOSES_P and opened.get("p"):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in SCOPE), -1)
            if depth >= 0 and stack[depth][0] == "p":
                close_to(depth)
        if tag in CLOSES:
            while (depth := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in CLOSES[tag] or stack[i][0] in SCOPE - CLOSES[tag]), -1)) >= 0 and stack[depth][0] in CLOSES[tag]:
                close_to(depth)
        if tag == "br":
            add(" ")
        if tag not in INLINE:
            block += 1
        if tag in VOID:
            continue
        never, named, labelled, label = tag in NEVER, False, False, tag
        if m[3]:
            for name, value in ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    labelled = True
                    if tag not in ("html", "body", "article", "main"):
                        found, firm = never_name(value)
                        never, named = never or firm, named or found
                    label += "." + value if name == "class" else ""
                elif name == "role":
                    never = never or value.lower() in NEVER_ROLE
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                    never = True
        _, around, path, link = stack[-1] if stack else ("", 0, 0, False)
        out.parent.append(around)
        out.tag.append(tag)
        out.never.append(never)
        out.named.append(named)
        out.labelled.append(labelled)
        if tag not in INLINE:
            if (path, label) not in paths:
                paths[path, label] = len(out.path_parent)
                out.path_parent.append(path)
                out.path_depth.append(out.path_depth[path] + 1)
            path = paths[path, label]
        stack.append((tag, len(out.parent) - 1, path, link or tag == "a" and not opened.get("h1")))
        opened[tag] = opened.get(tag, 0) + 1
    add(page[at:])
    return out


def path_scores(page: Page, nodes: list[Node], never: list[bool]) -> tuple[np.ndarray, float]:
    """(the fused score of each node's path, the threshold) from the paths' ratios, smoothed along the page."""
    of = {p: i for i, p in enumerate(dict.fromkeys(n.path for n in nodes))}
    path = np.array([of[n.path] for n in nodes])
    size = np.array([0 if never[n.element] else len(n.text.strip()) for n in nodes], float)
    linked = np.array([n.link for n in nodes])
    length = np.where(linked, 0, size)
    marks = np.array([0 if never[n.element] or n.link else len(PUNCTUATION.findall(n.text)) for n in nodes], float)
    each = np.bincount(path)
    ratios = [(np.bincount(path, w) / each)[path] for w in (length, marks)]
    # a neighbour's part falls with the distance, and with what the paths do not share
    smooth, norm = [r.copy() for r in ratios], np.ones(len(nodes))
    known: dict[tuple[int, int], float] = {}
    for gap in (1, 2):
        if len(nodes) <= gap:
            break
        near = np.exp(-0.5 * gap**2)
        pairs = [(a.path, b.path) for a, b in zip(nodes, nodes[gap:], strict=False)]
        for p in set(pairs) - known.keys():
            known[p] = page.shared(*p)
        part = near * np.array([known[p] for p in pairs])
        for r, s in zip(ratios, smooth, strict=True):
            s[gap:] += part * r[:-gap]
            s[:-gap] += part * r[gap:]
        norm[gap:] += near
        norm[:-gap] += near
    in_text = 1 - np.bincount(path, size - length) / np.maximum(np.bincount(path, size), 1)
    # a path of which more is links than text is one of links
    in_text[in_text <= 0.5] = 0
    fused = smooth[0] / norm * (1 + smooth[1] / norm)
    # A path's score is the mean of its nodes' less its links, and its weight in the threshold its text.
    score = np.bincount(path, fused) / each * in_text
    weight = np.bincount(path, length)
    if not weight.sum():
        return score[path], np.inf
    mean = np.average(score, weights=weight)
    return score[path], mean - 0.5 * np.sqrt(np.average((score - mean) ** 2, weights=weight))


def content_element(page: Page, content: list[Node], share: float) -> int:
    """The smallest element with nearly all of the content's text, or the article or main element around it; 0 if only the page has."""
    held = page.held(content)
    e = max((e for e in range(len(held)) if held[e] >= share * held[0]), default=0)
    # Inline elements and single blocks of prose are no containers: their parent is.
    while e and (page.tag[e] in INLINE or page.tag[e] in PROSE or page.tag[e] == "li"):
        e = page.parent[e]
    around = e
    while around and page.tag[around] not in ("article", "main"):
        around = page.parent[around]
    if around:
        return around
    over = page.parent[e]
    titled = any(t == "h1" and page.parent[i] == over for i, t in enumerate(page.tag))
    return over if e and titled and page.tag[over] not in ("", "html", "body") else e


def main_text(html_page: str | None, share: float = 0.9) -> str:
    """The page's main text: blocks in page order, one a line; empty for a page without any."""
    page = parse(html_page or "")
    seen = [n for n in page.nodes if n.path >= 0]
    if not seen:
        return ""
    never = page.down(page.never)

    def content_of(score: np.ndarray, least: float) -> list[Node]:
        return [n for n, s in zip(seen, score, strict=True) if s >= least and not never[n.element]]

    score, least = path_scores(page, seen, never)
    if any(page.named):
        content = content_of(score, least)
        held, half = page.held(content), sum(len(n.text) for n in content) / 2
        never = page.down([a or b and h <= half for a, b, h in zip(never, page.named, held, strict=True)])
        score, least = path_scores(page, seen, never)
    content = content_of(score, least)
    if not content:
        return ""
    root = content_element(page, content, share)
    inside = page.down([e == root for e in range(len(page.parent))])
    above = set()
    e = root
    while e:
        e = page.parent[e]
        above.add(e)

    def near(e: int) -> bool:
        while e not in above and not page.labelled[e]:
            e = page.parent[e]
        return e in above

    # prose that is in no labelled block but those around the content element
    beside = page.down([t in PROSE and (not root or near(page.parent[i])) for i, t in enumerate(page.tag)])
    passed = set()
    for n, s in zip(seen, score, strict=True):
        prior = 0.0 if never[n.element] else LIKELY if inside[n.element] or beside[n.element] else 1.0
        if s * prior >= least and prior:
            passed.add((n.path, n.block))
    kept = {b for _, b in passed}
    blocks: dict[int, list[str]] = {}
    for n in page.nodes:
        if n.block in kept and not never[n.element] and (n.path < 0 or (n.path, n.block) in passed):
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row a page.

    A null, empty or text-less page has an empty text; pages of any length and depth are read whole; a null page_id or url
    stays null; repeated rows give repeated rows; other columns, whatever their names, are ignored; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
