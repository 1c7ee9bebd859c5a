"""Keys and label lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text that stands for NULL inside a surrogate key.
NULL_MARKER = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*cols: Column | str) -> Column:
    """md5 of the columns as text, NULLs marked, joined by ``-``."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_MARKER)) for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def value_map(col: Column | str, mapping: dict[str, str], default: str | None = None) -> Column:
    """Replace values by a small literal mapping; unmapped values become ``default``."""
    c = F.col(col) if isinstance(col, str) else col
    looked_up = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[c]
    return looked_up if default is None else F.coalesce(looked_up, F.lit(default))
