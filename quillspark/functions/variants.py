"""Conversion between variants of a script by a table of pieces of text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a table that may be handed to every executor.
MOST_ENTRIES = 200_000


def converted(text: str, table: dict[str, str], longest: int) -> str:
    """The conversion that cuts the text into the fewest pieces, a piece being an entry or one character; ties to the longer first piece."""
    n = len(text)
    pieces, step = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        pieces[i] = 1 + pieces[i + 1]
        for size in range(2, min(longest, n - i) + 1):
            if 1 + pieces[i + size] <= pieces[i] and text[i : i + size] in table:
                pieces[i], step[i] = 1 + pieces[i + size], size
    out, i = [], 0
    while i < n:
        piece = text[i : i + step[i]]
        out.append(table.get(piece, piece))
        i += step[i]
    return "".join(out)


def converter(entries: DataFrame):
    """A function of a text column. entries: source, target; of equal sources the smallest target counts.

    Refuses tables beyond MOST_ENTRIES rows, which are handed to every executor.
    """
    rows = entries.groupBy("source").agg(F.min("target").alias("target")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    table = {r["source"]: r["target"] for r in rows if r["source"]}
    longest = max(map(len, table), default=1)

    @F.pandas_udf("string")
    def convert(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: None if x is None else converted(x, table, longest))

    return convert


def single_characters(text: Column, table: dict[str, str]) -> Column:
    """The native path for tables of single characters."""
    source = "".join(table)
    return F.translate(text, source, "".join(table[c] for c in source))
