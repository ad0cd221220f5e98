"""Items of web pages by selectors, such as messages: first selector with hits, and parts of each hit."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as X

#: Elements without content, those whose text isn't shown, and those that stand on lines of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "head", "title", "noscript"}
BLOCK = {"address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}
#: An element that begins ends an open one of these, as far as none of the second stands between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
#: What an end tag can't reach beyond.
SCOPE = {"table", "td", "th", "html"}

_PART = re.compile(r"""(?P<tag>^[A-Za-z][\w-]*|^\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")


class Element:
    """A start tag, where it stands, and what follows it up to its end: elements and texts in order."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Tree(HTMLParser):
    """Elements in order of their start tags; ends that are missing are implied, those without a start are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Element("", {}, None)
        self.open = Counter()  # so that a deep page isn't climbed for an element that isn't open

    def _close(self, tags: set[str], within: set[str]) -> None:
        node = self.at
        while any(self.open[t] for t in tags) and node.parent is not None and node.tag not in within:
            if node.tag in tags:
                while self.at is not node.parent:
                    self.open[self.at.tag] -= 1
                    self.at = self.at.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in BLOCK:
            self._close({"p"}, SCOPE)
        # Of an attribute that stands twice the first counts.
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, SCOPE - {tag})

    def handle_data(self, data):
        self.at.children.append(data)


def _below(element: Element):
    """Elements within one, in order."""
    stack = [c for c in reversed(element.children) if isinstance(c, Element)]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Element))


def inner_text(element: Element) -> str:
    """What is shown of an element: white space collapsed, a line end where a block or line breaks."""
    out, stack = [], [element]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(re.sub(r"[ \t\n\f\r]+", " ", node))
        elif node.tag == "br":
            out.append("\n")
        elif node.tag not in HIDDEN:
            edge = ["\n"] if node.tag in BLOCK and node is not element else []
            out += edge
            stack += [*edge, *reversed(node.children)]
    return re.sub(r" *\n[ \n]*", "\n", re.sub(" +", " ", "".join(out))).strip()


def _compiled(selectors: str) -> list[list[tuple[str, list]]]:
    """Of each selector between commas its steps: what stands between it and the one before (a blank or >), and tests."""
    if selectors.count("[") != selectors.count("]"):
        raise ValueError(f"selectors {selectors!r} aren't understood")
    found = []
    for selector in re.findall(r"""(?:[^,"'\[]|\[[^\]]*\]|"[^"]*"|'[^']*')+""", selectors):
        steps, between = [], " "
        for word in re.findall(r""">|(?:[^\s>\["']|\[(?:[^\]"']|"[^"]*"|'[^']*')*\])+""", selector.strip()):
            if word == ">":
                between = ">"
                continue
            tests = list(_PART.finditer(word))
            if "".join(t[0] for t in tests) != word:
                raise ValueError(f"selector {selector.strip()!r} isn't understood")
            steps.append((between, [t.groupdict() for t in tests]))
            between = " "
        found.append(steps)
    return found


def _passes(element: Element, tests: list) -> bool:
    for t in tests:
        value = element.attrs.get(t["name"]) if t["name"] else None
        wanted = next((x for x in (t["a"], t["b"], t["c"]) if x is not None), "")
        ok = (
            (t["tag"] == "*" or t["tag"].lower() == element.tag) if t["tag"] else element.attrs.get("id") == t["id"] if t["id"] else t["cls"] in element.attrs.get("class", "").split() if t["cls"]
            else value is not None and {None: True, "=": value == wanted, "*=": wanted != "" and wanted in value, "^=": wanted != "" and value.startswith(wanted), "$=": wanted != "" and value.endswith(wanted), "~=": wanted in value.split()}[t["op"]]
        )
        if not ok:
            return False
    return True


def _matches(element: Element, steps: list[tuple[str, list]]) -> bool:
    if not _passes(element, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    node = element.parent
    while node is not None and node.tag:
        if _matches(node, steps[:-1]):
            return True
        if steps[-1][0] == ">":
            return False
        node = node.parent
    return False


def _select(within: Element, compiled: list) -> list[Element]:
    return [e for e in _below(within) if any(_matches(e, steps) for steps in compiled)]


def found_items(html: str, items: list, fields: list) -> list[list[str | None]]:
    """Texts of the fields of each element that the first of ``items`` with any finds; null where an item lacks a field."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    hits = next((h for h in (_select(tree.root, i) for i in items) if h), [])
    first = lambda hit, field: next((inner_text(e) for e in _select(hit, field)), None)
    return [[first(hit, field) for field in fields] for hit in hits]


def items(html: Column | str, selectors: list[str], fields: dict[str, str]) -> Column:
    """Array of structs of a page's items, in order.

    Selectors hold tags, #id, .class, [attribute] with =, *=, ^=, $= or ~=,
    descendants, children (>) and commas.  A null page has none.
    """
    compiled, parts = [_compiled(s) for s in selectors], [_compiled(s) for s in fields.values()]

    @F.pandas_udf("array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: [] if page is None else [dict(zip(fields, row, strict=True)) for row in found_items(page, compiled, parts)])

    return found(html)


def messages(html: Column | str, kind: dict, target: str = "", last: int | None = None, placeholders: list[str] | None = None) -> Column:
    """sender, content and time of the last messages of a page that have content and whose sender holds ``target``."""
    fields = {k: kind[k] for k in ("sender", "content", "time")}
    filled = F.transform(items(html, kind["items"], fields), lambda m: F.struct(*(F.coalesce(X.strip(m[k]), F.lit("")).alias(k) for k in fields)))
    stay = F.filter(filled, lambda m: (m["content"] != "") & F.contains(m["sender"], F.lit(target)) & ~m["content"].isin(*(placeholders or [""])))
    return stay if last is None else F.when(F.size(stay) > last, F.slice(stay, -last, last)).otherwise(stay)
