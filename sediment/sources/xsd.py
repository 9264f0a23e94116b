"""The row schema an XSD declares, for the XML scan."""

from __future__ import annotations

import functools
import math
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import types as T

from sediment.types import parse_sql_type

# The column type of each built-in XSD type; others are STRING.
XSD_TYPES = {
    "string": "STRING", "normalizedString": "STRING", "token": "STRING", "anyURI": "STRING",
    "date": "STRING", "dateTime": "STRING", "time": "STRING",
    "boolean": "BOOLEAN",
    "integer": "BIGINT", "int": "INT", "long": "BIGINT", "short": "INT", "byte": "INT",
    "positiveInteger": "BIGINT", "nonNegativeInteger": "BIGINT",
    "negativeInteger": "BIGINT", "nonPositiveInteger": "BIGINT",
    "decimal": "DOUBLE", "float": "FLOAT", "double": "DOUBLE",
}

_XS = "{http://www.w3.org/2001/XMLSchema}"


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def _built_in(element: ET.Element, simple: dict[str, ET.Element]) -> str | None:
    """The built-in type a simple element comes down to; None if its type is not simple."""
    name = _local(element.get("type", "")) or None
    inline = element.find(f"{_XS}simpleType")
    if element.find(f"{_XS}complexType") is not None:
        return None
    met = set()
    while True:
        if name in XSD_TYPES:
            return name
        declared = simple.get(name) if name else inline
        if declared is None or name in met:
            return None if name else "string"
        met.add(name)
        base = declared.find(f"{_XS}restriction")
        if base is None:
            return "string"
        name = _local(base.get("base", ""))
        inline = base.find(f"{_XS}simpleType")


@dataclass(frozen=True)
class Child:
    """An element a row may have, and how often: `least` times to `most` times."""

    element: ET.Element
    least: int
    most: float


def _times(part: ET.Element) -> tuple[int, float]:
    most = part.get("maxOccurs", "1")
    return int(part.get("minOccurs", "1")), math.inf if most == "unbounded" else int(most)


class _Schema:
    """The declarations of an XSD that others refer to."""

    def __init__(self, root: ET.Element):
        self.simple = {t.get("name"): t for t in root.iter(f"{_XS}simpleType") if t.get("name")}
        self.complex = {t.get("name"): t for t in root.iter(f"{_XS}complexType") if t.get("name")}
        self.elements = {e.get("name"): e for e in root.findall(f"{_XS}element")}
        self.groups = {g.get("name"): g for g in root.findall(f"{_XS}group")}

    def type_of(self, child: Child, before: Child | None) -> str:
        """The SQL type of one value; a nested child is STRING."""
        found = [XSD_TYPES.get(_built_in(c.element, self.simple), "STRING") for c in (child, before) if c]
        if len(set(found)) > 1:
            raise ValueError(f"{child.element.get('name')!r} is declared with two types")
        return found[0]

    def both(self, first: dict[str, Child], second: dict[str, Child], either: bool) -> dict[str, Child]:
        """The children of two parts that stand behind each other, or of which a row has one."""
        out = {}
        for name in [*first, *(n for n in second if n not in first)]:
            x, y = first.get(name), second.get(name)
            known = x or y
            self.type_of(known, y if x else None)
            least, most = ([c.least if c else 0 for c in (x, y)], [c.most if c else 0 for c in (x, y)])
            out[name] = Child(known.element, min(least) if either else sum(least), max(most) if either else sum(most))
        return out

    def children(self, body: ET.Element, inside: tuple[str, ...] = ()) -> dict[str, Child]:
        """The child elements that a type or a part of it allows, in order.

        The parts of a sequence or `all` add up, of a choice a row has one; a part that may be there several times
        multiplies.  Groups, extensions and restrictions are followed; one that comes back to itself is an error.
        """
        kind = body.tag.removeprefix(_XS)
        parts = [found for part in body if (found := self.part(part, inside)) is not None]
        return functools.reduce(lambda x, y: self.both(x, y, kind == "choice"), parts) if parts else {}

    def part(self, part: ET.Element, inside: tuple[str, ...]) -> dict[str, Child] | None:
        """The children of one part; None if it is none."""
        kind = part.tag.removeprefix(_XS)
        if kind == "any":
            raise ValueError("a row that may have any element has no fixed schema")
        if kind == "element":
            declared = self.elements.get(_local(part.get("ref", "")), part)
            found = {declared.get("name"): Child(declared, 1, 1)}
        elif kind in ("sequence", "all", "choice"):
            found = self.children(part, inside)
        elif kind in ("complexContent", "restriction"):
            return self.children(part, inside)
        elif kind == "extension":
            base = self.referred("type", self.complex, part.get("base", ""), inside)
            return self.both(base, self.children(part, inside), either=False)
        elif kind == "group":
            found = self.referred("group", self.groups, part.get("ref", ""), inside)
        else:
            return None
        least, most = _times(part)
        return {n: Child(c.element, c.least * least, c.most * most if most else 0) for n, c in found.items()}

    def referred(self, kind: str, declared: dict[str, ET.Element], name: str, inside: tuple[str, ...]) -> dict[str, Child]:
        name = _local(name)
        if name not in declared:
            if kind == "type":  # a built-in type has no children
                return {}
            raise ValueError(f"the group {name!r} is not declared")
        if f"{kind} {name}" in inside:
            raise ValueError(f"the {kind} {name!r} refers to itself")
        return self.children(declared[name], (*inside, f"{kind} {name}"))


def read_xsd(text: str, row_tag: str = "record") -> T.StructType:
    """The leaf children of the element named `row_tag`, wherever it is declared.

    A child may be null if a row may lack it or it is nillable; a nested child is STRING.  A child that a row may have several times is
    STRING, the JSON array of its values, whose type the scan finds in the field's metadata as `items`.
    """
    root = ET.fromstring(text)
    row = next((e for e in root.iter(f"{_XS}element") if e.get("name") == row_tag), None)
    if row is None:
        tops = sorted(e.get("name") for e in root.findall(f"{_XS}element"))
        raise ValueError(f"no element {row_tag!r} is declared; the top elements are {tops}")
    schema = _Schema(root)
    name = _local(row.get("type", ""))
    body = row.find(f"{_XS}complexType")
    if body is None:
        body = schema.complex.get(name)
    if body is None:
        raise ValueError(f"element {row_tag!r} is a single value, not a row of fields")
    fields = []
    for child_name, child in schema.children(body, (f"type {name}",) if name else ()).items():
        if child.most:
            one = schema.type_of(child, None)
            several = child.most > 1
            nullable = child.least == 0 or child.element.get("nillable") == "true"
            fields.append(T.StructField(child_name, parse_sql_type("STRING" if several else one), nullable, {"items": one} if several else {}))
    if not fields:
        raise ValueError(f"element {row_tag!r} has no child elements")
    return T.StructType(fields)
