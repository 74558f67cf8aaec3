"""Main-text extraction by composite text density.

Each element's density is its characters per tag, damped by the share of link
text (Sun, Song and Liao, SIGIR 2011). Hidden elements and nav, footer, aside,
menu, dialog, button and a header outside an article are cut first. A form, or
a name with a word of boilerplate among others ('has-sidebar'), is only weak
evidence: such an element stays if it holds the densest subtree or over half of
the body's text outside links; a role, or a name of boilerplate words alone
('comments', 'site-footer'), stays with over nine tenths of it. Neither stays
by its share if an article or main lies elsewhere. The element whose children's
densities sum highest is the core. With the least density on its path to the
body as threshold, it is widened to parents whose other children reach the
threshold too; an article tag by itself decides nothing, a paragraph is never a
whole text. Of a core that is the body, children that are mostly links go. Its
text is given block by block.

Edge cases: null or empty html gives an empty text; unclosed, misnested, very
deep and very long markup is read whole, without recursion, in time in
proportion to its length. Of equal sums the first element in page order is the
core. Repeated rows and rows with null ids or URLs give one row each; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quotes count after `=` only, and a `>` between them does not end it.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: annotation (MathML), desc, metadata and defs (SVG) are never shown.
RAW = frozenset("script style title noscript template iframe select object annotation annotation-xml desc metadata defs".split())
#: Elements below these are no tags of the page: their text counts, they do not.
DRAWN = frozenset(("svg", "math"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
SCOPES = frozenset("table ul ol dl article section div main body html td th blockquote".split())
CUT_TAGS = frozenset("nav footer aside menu dialog button head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words of class and id names that mark boilerplate.
CUT_NAMES = frozenset(
    "ad ads adbox adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar sidenav nav navbar navigation topnav menu "
    "breadcrumb breadcrumbs footer foot masthead topbar comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager toolbar skip".split()
)
HEADS = frozenset(("header",))
#: Words that leave the meaning of a name of boilerplate words as it is.
NEUTRAL = frozenset("site page main global top bottom left right primary secondary area list section wrapper wrap container content box block inner outer thread bar links item items group".split())
#: Elements that are parts of a text, and so never the whole of it.
PIECES = frozenset("p li dt dd td th tr tbody blockquote pre h1 h2 h3 h4 h5 h6 span a b i em strong font center".split())
#: Evidence that an element is boilerplate, and the share of the body's text outside links from which on it stays.
KEPT, WEAK, STRONG, FINAL = range(4)
STAYS = {WEAK: 0.5, STRONG: 0.9}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _mark(tag: str, attrs: str, in_article: bool) -> int:
    if tag in CUT_TAGS:
        return FINAL
    if tag in ("body", "html", "main", "article"):
        return KEPT
    if tag == "header" and not in_article:
        return FINAL
    mark = WEAK if tag == "form" else KEPT
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return mark
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return FINAL
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return FINAL
        if name == "role" and value.lower() in CUT_ROLES:
            mark = STRONG
        if name == "role" and value.lower() == "form":
            mark = max(mark, WEAK)
        if name in ("class", "id"):
            cut = CUT_NAMES if in_article else CUT_NAMES | HEADS
            for part in value.split():
                words = {x.lower() for x in NAME_PART.findall(part)}
                if words & cut:
                    mark = max(mark, STRONG if words <= cut | NEUTRAL else WEAK)
    return mark


class Page:
    """Elements in page order (parents first) and texts as (element, block, text)."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.marks, self.drawn = ["#root"], [0], [KEPT], [False]
        self.texts: list[tuple[int, int, str]] = []
        self.stack, self.scopes = [0], [0]
        self.where: dict[str, list[int]] = {}
        self.articles = self.block = 0
        self._read(source)
        self._decide()

    def _read(self, source: str) -> None:
        """One pass; every search either ends at a mark that is taken or, once it fails, is not made again."""
        at, seen, n = 0, 0, len(source)
        final, quoted = source.rfind(">"), True
        while at < n:
            low = source.find("<", seen)
            if low < 0:
                break
            if source.startswith("<!--", low) or source.startswith("<![CDATA[", low):
                mark = "-->" if source[low + 2] == "-" else "]]>"
                self._say(source[at:low])
                end = source.find(mark, low + 4)
                at = seen = n if end < 0 else end + 3
                continue
            if low > final:
                break
            m = NAME.match(source, low)
            if not m:
                seen = low + 1
                if source[seen : seen + 1] in ("!", "?"):
                    self._say(source[at:low])
                    at = seen = source.index(">", low) + 1
                continue
            self._say(source[at:low])
            rest = REST.match(source, m.end()) if quoted else None
            quoted = rest is not None  # quotes that never close count no more from here on
            end = rest.end() if rest else source.index(">", low) + 1
            tag, attrs = m[2].lower(), source[m.end() : end - 1]
            if m[1]:
                self._end(tag)
                at = seen = end
            else:
                at = seen = self._start(tag, attrs, source, end)
        self._say(source[at:])

    def _say(self, text: str) -> None:
        if text:
            self.texts.append((self.stack[-1], self.block, text))

    def _push(self, i: int, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(i)
        self.articles += tag in ("article", "main")

    def _pop(self, to: int) -> None:
        """Closes the open elements from place `to` of the stack on."""
        while len(self.stack) > to:
            tag = self.tags[self.stack.pop()]
            self.where[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.articles -= tag in ("article", "main")

    def _open_at(self, tag: str) -> int:
        """Place of the innermost open `tag`, or -1 if there is none or a container is open inside it."""
        places = self.where.get(tag)
        return places[-1] if places and places[-1] >= self.scopes[-1] else -1

    def _end(self, tag: str) -> None:
        self.block += tag in BLOCK
        places = self.where.get(tag)
        if places and (tag in BLOCK or places[-1] >= self.scopes[-1]):
            self._pop(places[-1])

    def _start(self, tag: str, attrs: str, source: str, at: int) -> int:
        """Where reading goes on."""
        if tag in RAW and tag != "object" or tag == "textarea":
            end = re.compile(f"</{re.escape(tag)}[^>]*+(?:>|\\Z)", re.IGNORECASE).search(source, at)
            stop = end.end() if end else len(source)
            if tag == "textarea":
                self._open(tag, self.stack[-1], KEPT)
                self.texts.append((len(self.tags) - 1, self.block + 1, source[at : end.start() if end else stop]))
                self.block += 2
            return stop
        if tag == "object":
            return at
        if tag == "br":
            self.texts.append((self.stack[-1], self.block, " "))
        if tag in BLOCK:
            self.block += 1
            if tag not in ("html", "body") and (p := self._open_at("p")) > 0:
                self._pop(p)
        for ended in ENDS.get(tag, ()):
            if (place := self._open_at(ended)) > 0:
                self._pop(place)
        i = len(self.tags)
        self._open(tag, self.stack[-1], _mark(tag, attrs, self.articles > 0))
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            self._push(i, tag)
        return at

    def _open(self, tag: str, above: int, mark: int) -> None:
        self.tags.append(tag)
        self.parents.append(above)
        self.marks.append(mark)
        self.drawn.append(self.drawn[above] or self.tags[above] in DRAWN)

    def _decide(self) -> None:
        """Cuts by tag, and by evidence where the text does not speak against it."""
        n, known = len(self.tags), self.marks
        self._spread(FINAL)
        if not any(WEAK <= x <= STRONG for x in known):
            return
        for mark in (STRONG, WEAK):
            if mark not in known:
                continue
            plain, main = self._plain(), [x in ("article", "main") for x in self.tags]
            for i in range(n - 1, 0, -1):
                main[self.parents[i]] += main[i]
            above = [0] * n  # articles that are parents
            for i in range(1, n):
                up = self.parents[i]
                above[i] = above[up] + (self.tags[up] in ("article", "main"))
            holds = set()
            if mark == WEAK:
                x = self._densities()[4]
                while x:
                    holds.add(x)
                    x = self.parents[x]
            for i in range(1, n):
                if known[i] == mark and (i in holds or main[i] + above[i] == main[0] and plain[i] > STAYS[mark] * plain[0]):
                    known[i] = KEPT
            self._spread(mark)

    def _spread(self, least: int) -> None:
        """Cuts all elements marked `least` or more, with what is below them."""
        self.cuts = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            self.cuts[i] = self.cuts[self.parents[i]] or self.marks[i] >= least

    def _plain(self) -> list[int]:
        """Characters outside links below each element, without cut ones."""
        n = len(self.tags)
        plain, linked = [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parents[i]] or self.tags[i] == "a"
        for i, _, text in self.texts:
            if not self.cuts[i] and not linked[i]:
                plain[i] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parents[i]] += plain[i]
        return plain

    def _densities(self) -> tuple[int, list[int], list[int], list[float], int]:
        """(body, characters, those in links, densities, the element with the highest sum of its children's densities)."""
        n = len(self.tags)
        chars, linked, tags, links = [0] * n, [0] * n, [int(not x) for x in self.drawn], [0] * n
        for i, _, text in self.texts:
            if not self.cuts[i]:
                chars[i] += len("".join(text.split()))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parents[i]] or self.tags[i] == "a"
            if in_link[i]:
                linked[i], links[i] = chars[i], tags[i]
        for i in range(n - 1, 0, -1):
            if not self.cuts[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i]
                links[p] += links[i]
        body = next((i for i in range(n) if self.tags[i] == "body"), 0)
        share = linked[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(1, n):
            if chars[i] and not self.cuts[i] and not self.drawn[i]:
                base = math.log(chars[i] * linked[i] / max(1, chars[i] - linked[i]) + share * chars[i] + math.e)
                ratio = chars[i] / max(1, linked[i]) * tags[i] / max(1, links[i])
                density[i] = chars[i] / tags[i] * math.log(max(ratio, 1.0 + 1e-9)) / base
                sums[self.parents[i]] += density[i]
        best = max((i for i in range(n) if i and i != body and chars[i] and not self.cuts[i] and not self.drawn[i] and self.tags[i] != "html"), key=lambda i: (max(sums[i], density[i] if sums[i] == 0 else 0), -i), default=body)
        return body, chars, linked, density, best

    def core(self) -> int:
        """The element that holds the main text; 0 is the whole page."""
        n = len(self.tags)
        body, chars, linked, density, best = self._densities()
        path, up = [best], best
        while up and up != body:
            up = self.parents[up]
            path.append(up)
        threshold = min((density[i] for i in path if i and density[i]), default=0.0)
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            if chars[i] and not self.cuts[i]:
                children.setdefault(self.parents[i], []).append(i)
        while best and best != body and self.tags[best] != "main":
            above = self.parents[best]
            others = [i for i in children.get(above, []) if i != best]
            if self.tags[best] not in PIECES:
                if not others or all(density[i] < threshold for i in others):
                    if above == body or not others:
                        break
                if above == body and any(density[i] < threshold for i in others):
                    break
            best = above
        if best == body:  # its children are the article, but for lists of links
            for i in children.get(body, []):
                self.cuts[i] = 2 * linked[i] > chars[i]
            for i in range(body + 1, n):
                self.cuts[i] = self.cuts[i] or self.cuts[self.parents[i]]
        return best

    def text(self) -> str:
        core, n = self.core(), len(self.tags)
        inside = [False] * n
        for i in range(n):
            inside[i] = i == core or i > 0 and inside[self.parents[i]]
        out, now, parts = [], -1, []
        for i, block, text in self.texts:
            if inside[i] and not self.cuts[i]:
                if block != now:
                    out.append("".join(parts))
                    now, parts = block, []
                parts.append(html.unescape(text) if "&" in text else text)
        out.append("".join(parts))
        return "\n".join(x for x in (" ".join(x.split()) for x in out) if x)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
