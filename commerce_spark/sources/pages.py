"""Pages of a DataFrame behind opaque cursors: what a server of pages needs, on the engine's side."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def encoded(position: list) -> str:
    """A position as URL-safe text without padding."""
    return base64.urlsafe_b64encode(json.dumps(position, separators=(",", ":")).encode()).decode().rstrip("=")


def decoded(cursor: str, fields: int) -> list:
    """The position that a cursor holds; whatever isn't one is a ValueError."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not isinstance(found, list) or len(found) != fields + 1 or not isinstance(found[-1], int) or isinstance(found[-1], bool) or found[-1] < 1 or not all(v is None or isinstance(v, str) for v in found[:-1]):
        raise ValueError("not a cursor")
    return found


def page(df: DataFrame, order: list[str], size: int, cursor: str | None = None) -> tuple[list[Row], str | None]:
    """The next `size` rows in the order of the columns given (nulls first), and the cursor of the page after, None at the end.

    The cursor holds the last row's place: its order columns as text, and how many rows with just these values were served.
    So pages of one state join to the whole whatever ties there are. One row more than the page is looked at, to know
    whether another page follows. Each page is one top-k of the rows from its place on; the filter reaches the scan for the
    first order column.
    """
    if size < 1:
        raise ValueError("a page has one row at least")
    kinds = {c: df.schema[c].dataType for c in order}
    rows, served = df, 0
    if cursor is not None:
        *values, served = decoded(cursor, len(order))
        at = [F.lit(v).try_cast(kinds[c]).alias(c) for c, v in zip(order, values, strict=True)]
        if values[0] is not None:
            rows = rows.where(F.col(order[0]) >= at[0])
        rows = rows.where(F.struct(*order) >= F.struct(*at))
    rest = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    text = [F.col(c).cast("string").alias(f"_at{i}") for i, c in enumerate(order)]
    found = rows.select("*", *text).orderBy(*[F.asc_nulls_first(c) for c in order], rest).offset(served).limit(size + 1).collect()
    out = [Row(**{c: r[c] for c in df.columns}) for r in found[:size]]
    if len(found) <= size:
        return out, None
    place = lambda r: [r[f"_at{i}"] for i in range(len(order))]
    last = place(found[size - 1])
    same = sum(place(r) == last for r in found[:size])
    before = served if cursor is not None and last == values else 0
    return out, encoded([*last, same + before])
