"""MathML fragments that may stand in a publication: one well-formed formula that loads nothing and runs nothing."""

from __future__ import annotations

import re
from functools import lru_cache
from xml.parsers import expat

# Namespaces, the elements of a formula, and attributes that refer to resources.
NAMESPACE = "http://www.w3.org/1998/Math/MathML"
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"
ELEMENTS = set(
    "math mi mn mo mtext mspace ms mglyph mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maligngroup malignmark mstack mlongdiv msrow mscarries mscarry msline maction semantics annotation annotation-xml".split()
)
RESOURCES = set("altimg cdgroup definitionurl href macros src style".split())
XML_ATTRIBUTES = {"id", "lang", "space"}


class _Refused(Exception):
    pass


def _refuse(*_) -> None:
    raise _Refused


class _Formula:
    """Listens to a parser that reports names as `namespace local prefix`."""

    def __init__(self) -> None:
        self.depth, self.roots, self.default, self.root_default = 0, 0, False, False

    def namespace(self, prefix: str | None, uri: str | None) -> None:
        if uri != NAMESPACE:
            raise _Refused
        self.default = self.default or prefix is None

    def start(self, name: str, attributes: list[str]) -> None:
        uri, rest = name.split(" ")[:2] if " " in name else ("", name)
        if not self.depth:
            self.roots, self.root_default = self.roots + 1, self.default
            if rest != "math":
                raise _Refused
        # an element without a namespace is one of the formula's too, unless it says otherwise
        if rest not in ELEMENTS or uri != NAMESPACE and (uri or self.default):
            raise _Refused
        for key in attributes[::2]:
            parts = key.split(" ")
            plain = parts[0].lower()
            if len(parts) == 1 and (plain in RESOURCES or plain.startswith("on")) or len(parts) > 1 and (parts[0] != XML_NAMESPACE or parts[1] not in XML_ATTRIBUTES):
                raise _Refused
        self.depth, self.default = self.depth + 1, False

    def end(self, _name: str) -> None:
        self.depth -= 1

    def comment(self, _data: str) -> None:
        if not self.depth:
            raise _Refused


@lru_cache(512)
def mathml(value: str) -> str | None:
    """The fragment as it stands in XHTML, with its namespace; None if it is not safe."""
    # a root that closes itself is no formula, and blanks may not surround it
    if not value.startswith("<") or not value.endswith(">") or value.endswith("/>"):
        return None
    told, parser = _Formula(), expat.ParserCreate("utf-8", " ")
    parser.namespace_prefixes, parser.ordered_attributes = True, True
    parser.StartNamespaceDeclHandler, parser.StartElementHandler, parser.EndElementHandler, parser.CommentHandler = told.namespace, told.start, told.end, told.comment
    parser.XmlDeclHandler = parser.StartDoctypeDeclHandler = parser.ProcessingInstructionHandler = _refuse
    try:
        parser.Parse(value.encode(), True)
    except (_Refused, expat.ExpatError, UnicodeEncodeError):
        return None
    if told.roots != 1:
        return None
    return value if told.root_default else re.sub(r"^<([^\s>]+)", rf'<\1 xmlns="{NAMESPACE}"', value)


def formula(block: dict) -> str | None:
    """The formula of an equation block, where it has a safe one."""
    value = block.get("attributes", {}).get("mathml")
    return mathml(value) if block["kind"] == "equation" and isinstance(value, str) else None
