"""Extraction by a user's schema: a table function whose columns are the schema's fields.

A schema names a base selector and fields, each with a selector below the base and what is taken: its text, an attribute, its inner HTML, or a pattern's first group in its text.
Selectors are compounds (``tag.class#id[name=value]``) with blanks between an ancestor and a descendant.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Elements that have no end, and those whose text is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def below(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            one = todo.pop()
            if isinstance(one, str):
                out.append(one)
            elif one.tag not in SILENT:
                todo += reversed(one.children)
        return " ".join("".join(out).split())

    def html(self) -> str:
        return "".join(escape(c, quote=False) if isinstance(c, str) else c.outer() for c in self.children)

    def outer(self) -> str:
        said = "".join(f' {k}="{escape(v)}"' for k, v in self.attributes.items())
        return f"<{self.tag}{said}>" + ("" if self.tag in VOID else f"{self.html()}</{self.tag}>")


class Tree(HTMLParser):
    """A page's elements; an end without its beginning is passed over, an element without its end lasts as long as its parent."""

    def __init__(self, page: str):
        super().__init__()
        self.root = self.open = Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def fits(node: Node, compound: str) -> bool:
    tag = re.match(r"[\w-]*", compound)[0]
    if tag and tag != node.tag:
        return False
    for mark, name in re.findall(r"([.#])([\w-]+)", re.sub(r"\[[^\]]*\]", "", compound)):
        if mark == "#" and node.attributes.get("id") != name or mark == "." and name not in node.attributes.get("class", "").split():
            return False
    for name, value in re.findall(r"\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", compound):
        if name not in node.attributes or value and node.attributes[name] != value:
            return False
    return True


def selected(base: Node, selector: str) -> Iterator[Node]:
    *above, last = selector.split()
    for node in base.below():
        if fits(node, last):
            at, rest = node.parent, list(above)
            while at is not None and rest:
                if fits(at, rest[-1]):
                    rest.pop()
                at = None if at is base else at.parent
            if not rest:
                yield node


def field_of(base: Node, field: dict) -> str | None:
    node = next(selected(base, field["selector"]), None) if field.get("selector") else base
    value = None
    if node is not None:
        kind = field.get("type", "text")
        if kind == "attribute":
            value = node.attributes.get(field.get("attribute", ""))
        elif kind == "html":
            value = node.html()
        elif kind == "regex":
            found = re.search(field["pattern"], node.text())
            value = found and (found[1] if found.re.groups else found[0])
        else:
            value = node.text() or None
    return field.get("default") if value is None else value


@F.udtf
class Extracted:
    """extracted(html, schema): one row for each base element of a page, in their order, with its place and the schema's fields. A null page has no rows."""

    @staticmethod
    def analyze(html: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not schema.isConstantExpression or schema.value is None:
            raise ValueError("the schema must be a constant")
        out = StructType().add("place", IntegerType())
        for field in json.loads(schema.value)["fields"]:
            out = out.add(field["name"], StringType())
        return AnalyzeResult(out)

    def eval(self, html: str, schema: str) -> Iterator[tuple]:
        if html is None:
            return
        wanted = json.loads(schema)
        for place, base in enumerate(selected(Tree(html).root, wanted["baseSelector"])):
            yield (place, *(field_of(base, f) for f in wanted["fields"]))


def extracted(pages: DataFrame, html: str, schema: dict) -> DataFrame:
    """The columns of pages with place and the schema's fields, one row for each base element."""
    return pages.lateralJoin(Extracted(F.col(html).outer(), F.lit(json.dumps(schema)))).select(*pages.columns, "place", *(f["name"] for f in schema["fields"]))
