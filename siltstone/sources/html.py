"""HTML pages to text, Markdown, headings, tables and images. One parse a page inside an Arrow function; no shuffle.

Parsing rules: a new li, p, tr, td, th, dt or dd closes an open one of its kind; unknown end tags are ignored; script, style, meta, link and noscript are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
DROPPED = {"script", "style", "meta", "link", "noscript"}
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCK = {"ul", "ol", "table", "div", "article", "section", "nav", "body", "html", "main", "header", "footer"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        """All text, pieces stripped and run together."""
        return "".join(x.strip() if isinstance(x, str) else x.text() for x in self.children)

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.skip += tag not in VOID
            return
        if self.skip:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in BLOCK:
                break
            if self.open[i].tag in CLOSES.get(tag, ()):
                del self.open[i:]
                break
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.skip and data:
            self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def plain_text(root: Node) -> str:
    return "\n".join(s.strip() for s in root.strings() if s.strip())


def title(root: Node) -> str:
    return next((n.text() for n in root.walk() if n.tag == "title"), "")


class Page:
    """A parsed page whose pictures are numbered in order, to be rendered line by line. A form says what the lines of a tag are; tags without one give those of what they hold."""

    def __init__(self, root: Node):
        self.root = root
        self.number = {id(n): i for i, n in enumerate(n for n in root.walk() if n.tag == "img")}
        self.pictures = images(root)

    def mark(self, img: Node) -> str:
        """Placeholder of a picture: what its caption says, else its alternative text, else its number."""
        i = self.number[id(img)]
        said = self.pictures[i]
        return f"[IMAGE_{i + 1}: {said['caption'] or said['alt'] or f'图片{i + 1}'}]"

    def lines(self, n: Node, forms: dict[str, Callable[[Page, Node], list[str] | None]]) -> Iterator[str]:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            elif c.tag not in ("head", "title"):
                made = forms[c.tag](self, c) if c.tag in forms else None
                yield from self.lines(c, forms) if made is None else made


def _heading(_: Page, n: Node) -> list[str]:
    return ["", f"{'#' * int(n.tag[1])} {n.text()}", ""] if n.text() else []


def _items(n: Node) -> list[tuple[int, str]]:
    """Places and texts of a list's own items; empty ones only count."""
    own = [c.text() for c in n.children if isinstance(c, Node) and c.tag == "li"]
    return [(i, t) for i, t in enumerate(own, 1) if t]


def _paragraph(_: Page, n: Node) -> list[str] | None:
    """A paragraph's plain text. One that holds pictures and no text gives their placeholders; one with neither gives nothing."""
    if n.text():
        return [n.text(), ""]
    return None if any(c.tag == "img" for c in n.walk()) else []


def _link(_: Page, n: Node) -> list[str]:
    text, href = n.text(), n.attrs.get("href") or ""
    return [f"[{text}]({href})" if href and not href.startswith("#") else text] if text else []


def _marked(sign: str) -> Callable[[Page, Node], list[str]]:
    return lambda _, n: [f"{sign}{n.text()}{sign}"] if n.text() else []


def _code_block(_: Page, n: Node) -> list[str]:
    code = next((c for c in n.walk() if c.tag == "code"), None)
    return ["", "```", "".join(code.strings()), "```", ""] if code else []


_HEADINGS = {f"h{i}": _heading for i in range(1, 7)}
#: A table goes as a Markdown table, so that the chunkers find it.
MARKDOWN = _HEADINGS | {
    "img": lambda page, n: ["", page.mark(n), ""], "p": _paragraph, "a": _link, "b": _marked("**"), "strong": _marked("**"), "i": _marked("*"), "em": _marked("*"), "code": _marked("`"), "pre": _code_block,
    "ul": lambda _, n: ["", *(f"- {t}" for _, t in _items(n)), ""], "ol": lambda _, n: ["", *(f"{i}. {t}" for i, t in _items(n)), ""],
    "br": lambda *_: [""], "hr": lambda *_: ["", "---", ""], "table": lambda _, n: ["", table_markdown(*table(n)[:2]), ""],
}
STRUCTURED = _HEADINGS | {
    "img": lambda page, n: ["", page.mark(n), ""], "p": lambda _, n: [n.text(), ""] if n.text() else [],
    "ul": lambda _, n: ["", *(f"- {t}" for _, t in _items(n)), ""], "ol": lambda _, n: ["", *(f"1. {t}" for _, t in _items(n)), ""],
}


def _body(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


def to_markdown(root: Node) -> str:
    """Title first, then the body: headings, plain paragraphs and items, links (anchors within the page as text), emphasis, code, rules, tables, and placeholders for pictures. At most one empty line in a row."""
    head = [f"# {t}", ""] if (t := title(root)) else []
    return re.sub(r"\n{3,}", "\n\n", "\n".join([*head, *Page(root).lines(_body(root), MARKDOWN)])).strip()


def structured_text(root: Node) -> str:
    """The body's text with headings and lists marked and a placeholder at each picture's place; pictures inside paragraphs and items are left out."""
    return "\n".join(Page(root).lines(_body(root), STRUCTURED))


def headings(root: Node) -> list[dict]:
    """Levels and texts, by level and then by place in the page."""
    found = [(int(n.tag[1]), i, n.text()) for i, n in enumerate(root.walk()) if re.fullmatch("h[1-6]", n.tag)]
    return [{"level": lv, "text": t} for lv, _, t in sorted(found) if t]


def table(n: Node) -> tuple[list[str], list[list[str]], str]:
    """Headers (those of thead, else the first row), rows, caption."""
    rows = [[c.text() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    caption = next((x.text() for x in n.walk() if x.tag == "caption"), "")
    return (rows[0], rows[1:], caption) if rows else ([], [], caption)


def tables(root: Node) -> list[dict]:
    return [{"headers": h, "rows": r, "caption": c} for h, r, c in (table(n) for n in root.walk() if n.tag == "table") if h]


def table_markdown(headers: list[str], rows: list[list[str]]) -> str:
    """Ragged rows are padded to the widest."""
    wide = max([len(headers), *map(len, rows)], default=0)
    line = lambda r: "| " + " | ".join([*r, *[""] * (wide - len(r))]) + " |"
    return "\n".join([line(headers), "|" + " --- |" * wide, *map(line, rows)]) if wide else ""


# Types of pictures by the ending of their address.
TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".ico": "image/x-icon", ".bmp": "image/bmp", ".avif": "image/avif",
}
#: Characters of the text on either side of a picture.
BESIDE = 100


def srcset(value: str | None) -> list[dict]:
    """Addresses of a picture's variants with their descriptors (2x, 800w)."""
    words = [x.split() for x in (value or "").split(",")]
    return [{"url": w[0], "descriptor": w[1] if len(w) > 1 else None} for w in words if w]


def picture_type(src: str) -> str | None:
    """What a data address says of itself, else by the ending before a query."""
    if m := re.match(r"data:([^;,]*);", src):
        return m[1]
    end = re.search(r"\.[a-z]+$", src.lower().split("?")[0])
    return TYPES.get(end[0]) if end else None


def _beside(pieces: list[str | Node]) -> list[str]:
    """Texts of siblings, nearest first, until they pass BESIDE characters."""
    out: list[str] = []
    for c in pieces:
        if len(" ".join(out)) > BESIDE:
            break
        if t := c.strip() if isinstance(c, str) else c.text():
            out.append(t)
    return out


def images(root: Node) -> list[dict]:
    """Pictures in order: source (lazy ones and the first of srcset too), alternative text, caption (that of the figure, else title, else aria-label), width and height (attributes, else style),
    variants, type, whether the source holds the picture, and the text before and after it among its siblings."""
    out = []

    def size(n: Node, name: str) -> str | None:
        m = re.search(rf"{name}\s*:\s*([^;]+)", n.attrs.get("style") or "", re.IGNORECASE)
        return n.attrs.get(name) or (m[1].strip() if m else None)

    def look(n: Node, figure: Node | None) -> None:
        for i, c in enumerate(n.children):
            if not isinstance(c, Node):
                continue
            if c.tag == "img":
                a, variants = c.attrs, srcset(c.attrs.get("srcset"))
                src = a.get("src") or a.get("data-src") or a.get("data-lazy-src") or (variants[0]["url"] if variants else "")
                cap = next((x.text() for x in figure.walk() if x.tag == "figcaption"), "") if figure else ""
                out.append({
                    "src": src, "alt": a.get("alt") or "", "caption": cap or a.get("title") or a.get("aria-label") or "", "width": size(c, "width"), "height": size(c, "height"), "srcset": variants,
                    "mime": picture_type(src), "is_base64": src.startswith("data:"), "before": " ".join(reversed(_beside(n.children[:i][::-1])))[:BESIDE], "after": " ".join(_beside(n.children[i + 1 :]))[:BESIDE],
                })
            look(c, c if c.tag == "figure" else figure)

    look(root, None)
    return out


def _apply(pages: DataFrame, f: Callable[[Node], object], kind: str, out: str, html: str = "html") -> DataFrame:
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([f(parse(h)) for h in x])

    return pages.withColumn(out, run(html))


def html_to_markdown(pages: DataFrame) -> DataFrame:
    return _apply(pages, to_markdown, "string", "markdown").drop("html")


def html_structured_text(pages: DataFrame) -> DataFrame:
    return _apply(pages, structured_text, "string", "text").drop("html")


def html_plain_text(pages: DataFrame) -> DataFrame:
    return _apply(pages, plain_text, "string", "text").drop("html")


def html_headings(pages: DataFrame) -> DataFrame:
    x = _apply(pages, headings, "array<struct<level:int,text:string>>", "h").drop("html")
    keep = [c for c in x.columns if c != "h"]
    return x.select(*keep, F.posexplode("h").alias("i", "e")).select(*keep, F.col("i").cast("long").alias("i"), F.col("e.level").cast("long").alias("level"), F.col("e.text").alias("text"))


def html_tables(pages: DataFrame) -> DataFrame:
    x = _apply(pages, tables, "array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>", "t").drop("html")
    return x.select(*[c for c in x.columns if c != "t"], F.inline("t"))


def html_images(pages: DataFrame) -> DataFrame:
    x = _apply(pages, images, "array<struct<src:string,alt:string,caption:string,width:string,height:string,srcset:array<struct<url:string,descriptor:string>>,mime:string,is_base64:boolean,before:string,after:string>>", "m").drop("html")
    return x.select(*[c for c in x.columns if c != "m"], F.inline("m"))
