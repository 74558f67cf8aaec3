"""HTML trees: markdown rendering, boilerplate removal, CSS selectors, text adapters (Arrow UDFs; a tree is parsed once).

Selectors: tag, #id, .class, [attr], [attr=value], joined, with descendant and
child (`>`) combinators; anything else is reported as an error and matches
nothing, and without any match the whole page is used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markdown import misses_structure
from .results import json_ld
from .safety import sanitise

MAX_CHARS = 2 << 20
EMPTY = "__PARSERS_EXTRACTED_NO_TEXT__"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside script style noscript".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0", re.IGNORECASE)
BLOCKS = frozenset("p div section article main header body html ul ol table tr blockquote figure form dl dt dd".split())
SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)")
PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == self.at.tag and tag in ("p", "li", "td", "th", "tr"):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(source: str, limit: int | None = MAX_CHARS) -> Node:
    builder = _Builder()
    builder.feed(source[:limit])
    builder.close()
    return builder.root


class Located(Node):
    """An element with its place in the source, and the end tag that the source leaves out."""

    __slots__ = ("end", "missing", "start")


class _Locator(_Builder):
    def __init__(self, source: str) -> None:
        super().__init__()
        self.source, self.lines = source, [0, *(m.end() for m in re.finditer("\n", source))]

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _add(self, tag: str, attrs: list, filled: bool) -> None:
        here = self._here()
        if tag == self.at.tag and tag in ("p", "li", "td", "th", "tr"):
            self.at.end = here
            self.at = self.at.parent
        node = Located(tag, {k: v or "" for k, v in attrs}, self.at)
        node.start, node.end, node.missing = here, None if filled else here + len(self.get_starttag_text()), f"</{tag}>" if filled else ""
        self.at.children.append(node)
        if filled:
            self.at = node

    def handle_starttag(self, tag, attrs):
        self._add(tag, attrs, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs, False)

    def handle_endtag(self, tag):
        here, node = self._here(), self.at
        super().handle_endtag(tag)
        while node is not self.at:
            node.end = here
            if node.parent is self.at:
                node.end, node.missing = self.source.find(">", here) + 1 or None, ""
            node = node.parent


def located(source: str) -> Node:
    """The tree of a whole page, each element with its place."""
    builder = _Locator(source)
    builder.feed(source)
    builder.close()
    return builder.root


def walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


class _Anchors(HTMLParser):
    """a[href] elements in page order, read without building a tree."""

    def __init__(self, most: int) -> None:
        super().__init__(convert_charrefs=True)
        self.most, self.found, self.parts = most, [], []
        self.open: list[tuple[str, int]] = []  # tags around, each with its anchor or -1
        self.counts: dict[str, int] = {}
        self.unfilled: dict[int, int] = {}  # open anchors and the characters of their labels so far

    def handle_starttag(self, tag, attrs):
        given, k = dict(reversed(attrs)), -1
        if tag == "a" and "href" in given:
            k = len(self.found)
            text = lambda name: " ".join((given.get(name) or "").split())
            self.found.append({"href": (given["href"] or "").strip(), "label": "", "title": text("title")[: self.most], "rel": text("rel").split()})
            self.parts.append([])
            self.unfilled[k] = 0
        if tag not in VOID:
            self.open.append((tag, k))
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.counts.get(tag):
            return
        while True:
            gone, k = self.open.pop()
            self.counts[gone] -= 1
            self.unfilled.pop(k, None)
            if gone == tag:
                return

    def handle_data(self, data):
        if self.unfilled and self.open[-1][0] not in ("script", "style"):
            size = len("".join(data.split()))
            for k in list(self.unfilled):
                self.parts[k].append(data)
                self.unfilled[k] += size
                if self.unfilled[k] > self.most:
                    del self.unfilled[k]


def anchors(source: str | None, most: int = 200) -> list[dict]:
    """href, label, title and rel of every a[href] in page order; the label is its text without tags, up to `most` characters.

    A page is read whole. Unclosed anchors end with the element around them; comments, scripts and styles hold none.
    """
    reader = _Anchors(most)
    reader.feed(source or "")
    reader.close()
    for row, parts in zip(reader.found, reader.parts, strict=True):
        row["label"] = " ".join("".join(parts).split())[:most]
    return reader.found


def strip_boilerplate(root: Node) -> Node:
    """Without navigation, footers, asides, scripts, styles and hidden elements."""
    for node in walk(root):
        node.children = [c for c in node.children if isinstance(c, str) or not (c.tag in DROPPED or HIDDEN.search(c.attrs.get("style", "")))]
    return root


def _fits(node: Node, simple: str) -> bool:
    m = SIMPLE.fullmatch(simple)
    if m["tag"] not in (None, "*", node.tag):
        return False
    for name, kind, attr, value in PART.findall(m["rest"]):
        if name and node.attrs.get("id") != name or kind and kind not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or value and node.attrs[attr] != value):
            return False
    return True


def compile_selector(selector: str) -> list[str] | None:
    """Alternating simple selectors and combinators, or None outside the subset."""
    tokens = re.sub(r"\s*>\s*", " > ", selector.strip()).split()
    simple = [t for t in tokens if t != ">"]
    if not simple or tokens[0] == ">" or tokens[-1] == ">" or any(not t or not SIMPLE.fullmatch(t) for t in simple):
        return None
    return tokens


def matches(node: Node, tokens: list[str]) -> bool:
    if not _fits(node, tokens[-1]):
        return False
    rest = tokens[:-1]
    if not rest:
        return True
    if rest[-1] == ">":
        return node.parent is not None and matches(node.parent, rest[:-1])
    above = node.parent
    while above is not None:
        if matches(above, rest):
            return True
        above = above.parent
    return False


def select(source: str, selectors: list[str]) -> tuple[str, list[str], list[str]]:
    """(html of all matches in selector order, selectors that matched, selectors outside the subset).

    A match is given as the page spells it, character references included; an end tag that the page leaves out is added.
    """
    wanted = list(dict.fromkeys(s.strip()[:500] for s in selectors if s.strip()))[:20]
    root, parts, used, errors = located(source), [], [], []
    taken: set[int] = set()
    for selector in wanted:
        tokens = compile_selector(selector)
        if tokens is None:
            errors.append(selector)
            continue
        found = [n for n in walk(root) if n.parent is not None and matches(n, tokens)]
        used += [selector] * bool(found)
        parts += [source[n.start : n.end] + n.missing for n in found if id(n) not in taken]
        taken.update(id(n) for n in found)
    return "\n".join(parts) if parts else source, used, errors


def _table(node: Node) -> str:
    rows = [[" ".join(render(c, inline=True).split()).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in walk(node) if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def render(node: Node, inline: bool = False) -> str:
    """Markdown of a tree, without recursion into ordinary elements (tables and code are leaves)."""
    out: list[str] = []
    stack: list = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
            continue
        if isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
            continue
        before = after = ""
        if x.tag == "table" and not inline:
            out.append(f"\n\n{_table(x)}\n\n")
            continue
        if x.tag == "pre":
            text = "".join(c for n in walk(x) for c in n.children if isinstance(c, str))
            out.append(f"\n\n```\n{text.strip(chr(10))}\n```\n\n")
            continue
        if re.fullmatch("h[1-6]", x.tag):
            before, after = f"\n\n{'#' * int(x.tag[1])} ", "\n\n"
        elif x.tag == "li":
            before = "\n- "
        elif x.tag in ("b", "strong"):
            before = after = "**"
        elif x.tag in ("i", "em"):
            before = after = "*"
        elif x.tag == "code":
            before = after = "`"
        elif x.tag == "a" and x.attrs.get("href"):
            before, after = "[", f"]({x.attrs['href']})"
        elif x.tag == "br":
            before = "\n"
        elif x.tag in BLOCKS:
            before = after = "\n\n"
        out.append(before)
        stack.append((after,))
        stack += reversed(x.children)
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out)) if not any("```" in o for o in out) else "".join(out)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def bounded(value, depth: int = 8, items: int = 200):
    if depth == 0:
        return "..."
    if isinstance(value, dict):
        return {k: bounded(v, depth - 1, items) for k, v in list(value.items())[:items]}
    return [bounded(v, depth - 1, items) for v in value[:items]] if isinstance(value, list) else value


def adapt(text: str) -> tuple[str, str]:
    """(kind, markdown) of responses that are no HTML: json, feed or plain; ('html', '') otherwise."""
    t = text.strip()
    if t[:1] in ("{", "["):
        try:
            return "json", "# JSON response\n\n```json\n" + json.dumps(bounded(json.loads(t)), ensure_ascii=False, indent=2) + "\n```"
        except (ValueError, RecursionError):
            pass
    head = t[:500].lower()
    if "<rss" in head or "<feed" in head:
        root = parse(t)
        names = [" ".join("".join(c for n in walk(k) for c in n.children if isinstance(c, str)).split()) for x in walk(root) if x.tag in ("item", "entry") for k in x.children if isinstance(k, Node) and k.tag == "title"]
        return "feed", f"# {'RSS' if '<rss' in head else 'Atom'} feed\n\n" + "\n".join(f"- {n}" for n in names)
    return ("html", "") if re.search(r"<[a-zA-Z!/]", t) or not t else ("plain", text)


def to_markdown(source: str | None) -> str:
    """Markdown of a response, or the marker of an empty one; never raises on odd markup."""
    if not source:
        return EMPTY
    kind, text = adapt(source)
    if kind == "html":
        text = render(strip_boilerplate(parse(source)))
    return normalise(text) or EMPTY


def normalise(markdown: str) -> str:
    return markdown.replace("\\_", "_").strip()


def plain(node: Node) -> str:
    return "".join(c for n in walk(node) for c in n.children if isinstance(c, str))


def content_root(root: Node) -> Node:
    """The first main or article, else the body, else all."""
    nodes = list(walk(root))
    return next((n for n in nodes if n.tag in ("main", "article")), next((n for n in nodes if n.tag == "body"), root))


def hints(root: Node) -> dict[str, bool]:
    """What the content of a page has that its markdown should show."""
    tags = [n for n in walk(content_root(root))]
    return {
        "heading": any(re.fullmatch("h[1-6]", n.tag) for n in tags), "table": any(n.tag == "table" for n in tags),
        "code": any(n.tag in ("pre", "code") for n in tags), "link": any(n.tag == "a" and "href" in n.attrs for n in tags),
    }


def microdata(root: Node) -> str:
    """Title and body of the schema.org items in a page's attributes, as markdown; '' without any."""
    parts: list[str] = []
    for item in walk(root):
        if "itemscope" not in item.attrs or "itemprop" in item.attrs:
            continue
        found: dict[str, str] = {}
        stack = list(item.children)[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                continue
            for name in x.attrs.get("itemprop", "").split():
                value = x.attrs.get("content") or x.attrs.get("href") or x.attrs.get("src") or " ".join(plain(x).split())
                found.setdefault(name, value)
            if "itemscope" not in x.attrs:
                stack += reversed(x.children)
        title = next((found[k] for k in ("headline", "name", "title") if found.get(k)), "")
        body = next((found[k] for k in ("articleBody", "text", "description") if found.get(k)), "")
        parts += [f"# {title}"] * bool(title) + [body] * bool(body)
    return "\n\n".join(parts)


def extraction(source: str | None) -> dict:
    """What the extraction chain chooses from: adapted text of other responses, hints, and three renderings from the narrowest on."""
    out = {"adapted": None, "hints": {"heading": False, "table": False, "code": False, "link": False}, "main": None, "microdata": None, "page": None, "plain": None}
    if not (source or "").strip():
        return out
    kind, text = adapt(source)
    if kind != "html":
        return out | {"adapted": normalise(text) or None}
    root = parse(source)
    out["hints"] = hints(root)
    out["microdata"] = normalise(microdata(root)) or None
    strip_boilerplate(root)
    core = content_root(root)
    out["main"] = normalise(render(core)) or None if core.tag in ("main", "article") else None
    out["page"] = normalise(render(root)) or None
    out["plain"] = normalise(" ".join(plain(root).split())) or None
    return out


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _B = T.StringType(), T.BooleanType()


@F.pandas_udf(_struct(adapted=_S, hints=_struct(heading=_B, table=_B, code=_B, link=_B), main=_S, microdata=_S, page=_S, plain=_S))
def extraction_of(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extraction(x) for x in source], columns=["adapted", "hints", "main", "microdata", "page", "plain"])


def extracted(pages: DataFrame, html: str = "html", words: dict[str, str] | None = None) -> DataFrame:
    """pages with `markdown`: the first rendering that shows the page's structure, made safe; EMPTY for pages without text.

    In order: text of other responses, the main element, schema.org data, the page, its plain text, then those that lack structure.
    """
    got = pages.withColumn("_x", extraction_of(F.col(html)))
    data = F.coalesce(F.nullif(json_ld(F.substring(F.col(html), 1, MAX_CHARS)), F.lit("")), F.col("_x.microdata"))
    whole = lambda c: F.when(~misses_structure(F.col(c), F.col("_x.hints")), F.col(c))
    chosen = F.coalesce("_x.adapted", whole("_x.main"), data, whole("_x.page"), "_x.plain", "_x.page", "_x.main")
    return got.withColumn("markdown", F.coalesce(sanitise(chosen, words), F.lit(EMPTY))).drop("_x")


@F.pandas_udf(T.StringType())
def markdown_of(source: pd.Series) -> pd.Series:
    return source.map(to_markdown, na_action=None)


@F.pandas_udf(T.StringType())
def response_kind(source: pd.Series) -> pd.Series:
    return source.map(lambda x: adapt(x or "")[0])


@F.pandas_udf(T.ArrayType(_struct(href=_S, label=_S, title=_S, rel=T.ArrayType(_S))))
def anchors_of(source: pd.Series) -> pd.Series:
    return source.map(anchors, na_action=None)


def selected(selectors: list[str]):
    """A UDF: struct of the selected html, what matched and what is no supported selector."""

    @F.pandas_udf("html string, used array<string>, errors array<string>")
    def run(source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([select(x or "", selectors) for x in source], columns=["html", "used", "errors"])

    return run


def register(spark: SparkSession) -> None:
    """Makes the UDFs of this module callable from SQL: page_markdown, response_kind, page_anchors."""
    for name, udf in (("page_markdown", markdown_of), ("response_kind", response_kind), ("page_anchors", anchors_of)):
        spark.udf.register(name, udf)
