"""Basic and word-piece tokenization with features of a fixed length, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# Special tokens.
UNKNOWN, START, END = "[UNK]", "[CLS]", "[SEP]"
#: Words of more characters are unknown.
LONGEST_WORD = 200
#: Blocks of CJK ideographs, as code points.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _splits(ch: str) -> bool:
    cp = ord(ch)
    return any(a <= cp <= b for a, b in CJK) or unicodedata.category(ch).startswith("P") or (33 <= cp < 127 and not ch.isalnum())


def basic_tokens(text: str, lower: bool = True) -> list[str]:
    """Words, with punctuation and ideographs apart; control characters gone; lower case without accents if asked."""
    kept = []
    for ch in text:
        cat = unicodedata.category(ch)
        if ch in "\t\n\r" or cat == "Zs":
            kept.append(" ")
        elif ch not in "\0�" and not cat.startswith("C"):
            kept.append(f" {ch} " if _splits(ch) else ch)
    text = "".join(kept)
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return "".join(f" {c} " if _splits(c) else c for c in text).split()


def pieces(word: str, vocabulary: dict[str, int]) -> list[str]:
    """The longest entry from the left, again and again; entries inside a word begin with ##. Unknown if some part has none."""
    if len(word) > LONGEST_WORD:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [UNKNOWN]
        out.append(mark + word[at:end])
        at = end
    return out


def tokenizer(vocabulary: dict[str, int], lower: bool = True):
    """A function of a text column: array of pieces."""

    @F.pandas_udf("array<string>")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: [p for w in basic_tokens(x or "", lower) for p in pieces(w, vocabulary)])

    return tokens


def char_features(vocabulary: dict[str, int], length: int = 128):
    """A function of a text column: ids, mask and segments of [CLS] characters [SEP], cut and padded to `length`."""
    unknown = vocabulary.get(UNKNOWN, 0)

    @F.pandas_udf("struct<ids:array<int>,mask:array<int>,segments:array<int>>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            rows = []
            for x in t:
                ids = [vocabulary.get(p, unknown) for p in [START, *[c.lower() for c in (x or "") if not c.isspace()][: length - 2], END]]
                rows.append((ids + [0] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids)), [0] * length))
            yield pd.DataFrame(rows, columns=["ids", "mask", "segments"])

    return features
