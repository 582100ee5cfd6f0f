"""Results as an aligned text table or as CSV; both take the rows of a finished, small result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NUMBER_LIKE = re.compile(r"[+-]?\d+(\.\d+)?%?[a-zA-Zµ]*")
CUT = "…"


def text_of(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(text_of(v) for v in value) + "]"
    return str(value)


def cells(df: DataFrame, limit: int | None = None) -> tuple[list[str], list[bool], list[list[str]]]:
    """Labels, whether each type is numeric, and rows as text; at most ``limit`` rows if it is given."""
    rows = (df if limit is None else df.limit(limit)).collect()
    numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema.fields]
    return df.columns, numeric, [[text_of(v) for v in row] for row in rows]


def right_aligned(numeric: list[bool], rows: list[list[str]]) -> list[bool]:
    """A column's type has one vote, each cell another; right needs more than half. Empty cells side with the type."""
    out = []
    for i, number in enumerate(numeric):
        votes = [number] + [number if not (cell := row[i] if i < len(row) else "") else bool(_NUMBER_LIKE.fullmatch(cell)) for row in rows]
        out.append(sum(votes) * 2 > len(votes))
    return out


def widths(need: list[int], right: list[bool], total: int) -> list[int]:
    """Widths that sum to at most ``total`` less the gaps; right columns keep theirs, left columns share what is left fairly."""
    room = total - (len(need) - 1)
    if sum(need) <= room:
        return list(need)
    out = list(need)
    left = [i for i, r in enumerate(right) if not r]
    if left:
        share_out(out, need, left, room - sum(n for n, r in zip(need, right) if r))
    for group in ([i for i, r in enumerate(right) if r], left):
        while sum(out) > room and any(out[i] > 1 for i in group):
            widest = max(group, key=lambda i: out[i])
            out[widest] -= 1
    return out


def share_out(out: list[int], need: list[int], columns: list[int], room: int) -> None:
    """Columns that need no more than the average get it all; the rest share evenly, the first ones what is left over."""
    waiting = list(columns)
    while waiting:
        each = max(1, room // len(waiting))
        small = [i for i in waiting if need[i] <= each]
        if not small:
            break
        for i in small:
            out[i] = need[i]
            room -= need[i]
            waiting.remove(i)
    if waiting:
        each, over = divmod(max(room, len(waiting)), len(waiting))
        for k, i in enumerate(waiting):
            out[i] = each + (k < over)


def _fit(text: str, width: int, right: bool) -> str:
    if len(text) > width:
        text = text[: width - 1] + CUT if width > 2 else text[:width]
    return text.rjust(width) if right else text.ljust(width)


def table(labels: list[str], numeric: list[bool], rows: list[list[str]], width: int = 120) -> str:
    """Header, dashes and rows, cut to the width."""
    rows = [[*(c.replace("\n", " ") for c in row), *[""] * (len(labels) - len(row))] for row in rows]
    right = right_aligned(numeric, rows)
    size = widths([max([len(h), *(len(r[i]) for r in rows)]) for i, h in enumerate(labels)], right, width)
    line = lambda texts: " ".join(_fit(t, w, r) for t, w, r in zip(texts, size, right)).rstrip()
    return "\n".join([line(labels), " ".join("-" * w for w in size), *(line(r) for r in rows)]) + "\n"


def csv_row(row: list[str], cell_width: int | None = None) -> str:
    """Cells with doubled quotes, and a backslash before commas and in place of line breaks; nulls are empty."""
    cut = [c if cell_width is None or len(c) <= cell_width else c[:cell_width] for c in row]
    return ",".join(c.replace('"', '""').replace(",", "\\,").replace("\n", "\\n") for c in cut) + "\n"


def csv(labels: list[str], rows: list[list[str]], cell_width: int | None = None) -> str:
    return ",".join(labels) + "\n" + "".join(csv_row(row, cell_width) for row in rows)
