"""The answer of an answer space that a generated text gives: a matcher is compiled once for each space of a task."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNMATCHED = "__unmatched__"
#: Matchers that a Python worker keeps; further spaces are compiled anew.
KEPT = 4096
# fixed values: characters stripped from both ends of a region, the pattern of an answer line, what a whole word may not touch
STRIPPED = "`'\".。,:：;； \t\r\n"
ANSWER_LINE = re.compile(r"answer\s*[:：]\s*([^\n\r]+)", re.IGNORECASE)
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


class Matcher:
    """Candidates by length down, in their order among equals. At each place of a text the first candidate that stands there as a
    whole word is the longest one; of those of all places the first in order is the one held."""

    def __init__(self, space: Sequence[str]):
        self.ordered = sorted((s for s in space if s is not None), key=len, reverse=True)
        self.rank: dict[str, int] = {}
        for k, s in enumerate(self.ordered):
            self.rank.setdefault(s.lower(), k)
        self.held = re.compile(f"{BEFORE}(?=({'|'.join(map(re.escape, self.rank))}){AFTER})")

    def in_region(self, region: str) -> str | None:
        exact = self.rank.get(region.strip().strip(STRIPPED).lower())
        if exact is None:
            exact = min((self.rank[x] for x in self.held.findall(region.lower())), default=None)
        return None if exact is None else self.ordered[exact]

    def __call__(self, text: str | None) -> str:
        if text is None or not self.rank:
            return UNMATCHED
        lines = ANSWER_LINE.findall(text)
        for region in (*lines[-1:], text):
            found = self.in_region(region)
            if found is not None:
                return found
        return UNMATCHED


@lru_cache(maxsize=KEPT)
def matcher(space: tuple[str | None, ...]) -> Matcher:
    return Matcher(space)


def _normalized(text: pd.Series, space: pd.Series) -> pd.Series:
    return pd.Series([matcher(() if s is None else tuple(s))(t) for t, s in zip(text, space, strict=True)], dtype=object)


def normalize_prediction(text: Column, space: Column) -> Column:
    """The answer of the space that a generated text gives. The last `answer:` line is tried before the whole text; in each, a
    region equal to a candidate, then one that holds a candidate as a whole word; candidates by length down, in their order
    among equals. `__unmatched__` if none fits, and for a null text or space."""
    return F.pandas_udf(_normalized, "string")(text.cast("string"), space.cast("array<string>"))
