"""Codebooks: codes with labels, objectives and ordered patterns, given by the user as a small table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A codebook is turned into expressions, so it may have no more rows than a plan can hold.
MOST_PATTERNS = 2_000
SCHEMA = "family string, code string, label string, objective string, pattern_idx int, pattern string"


@dataclass(frozen=True)
class Code:
    code: str
    label: str
    objective: str
    patterns: tuple[str, ...]


def load(table: DataFrame, family: str) -> list[Code]:
    """The codes of one family, in order of code and pattern index.  Patterns that match nothing at all are refused."""
    rows = table.where(F.col("family") == family).orderBy("code", "pattern_idx").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns in family {family}")
    found: dict[str, Code] = {}
    for r in rows:
        if re.search(r.pattern, "") is not None:
            raise ValueError(f"pattern of {r.code} matches the empty text: {r.pattern!r}")
        old = found.get(r.code)
        found[r.code] = Code(r.code, r.label, r.objective, (*(old.patterns if old else ()), r.pattern))
    return list(found.values())
