"""Names as bytecode writes them, in source form."""

from __future__ import annotations

#: The letters of primitive types in descriptors.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def _read_type(text: str, at: int) -> tuple[str, int] | None:
    """The type that starts at a place of a descriptor, and the place after it."""
    depth = 0
    while at < len(text) and text[at] == "[":
        depth, at = depth + 1, at + 1
    if at >= len(text):
        return None
    if text[at] == "L":
        end = text.find(";", at)
        if end < 0:
            return None
        return text[at + 1 : end].replace("/", ".").replace("$", ".") + "[]" * depth, end + 1
    if text[at] not in PRIMITIVES:
        return None
    return PRIMITIVES[text[at]] + "[]" * depth, at + 1


def java_name(text: str | None) -> str | None:
    """A class name in source form: ``[I`` is ``int[]``, ``Lx/Y$Z;`` is ``x.Y.Z``; slashes of plain names become dots."""
    if not text:
        return text
    if text[0] in "[L" and (found := _read_type(text, 0)) and found[1] == len(text):
        return found[0]
    return text.replace("/", ".")


def simple_descriptor(text: str | None) -> str | None:
    """The argument types of a method descriptor, java.lang left as it is; anything else is returned unchanged."""
    if not text or text[0] != "(" or ")" not in text:
        return text
    at, out = 1, []
    while at < len(text) and text[at] != ")":
        if not (found := _read_type(text, at)):
            return text
        name, at = found
        out.append(name.rsplit(".", 1)[-1])
    return "(" + ", ".join(out) + ")"
