"""Text scalars as native column expressions: normalisers, character classes, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that results depend on.
PUNCTUATION = ".?!:。，,、？：；{}[]()【】“‘’”《》/！%……（）<>@#$~^￥%&*\"'=+-;　"
STOPS = "!?.,！？，。；;"
HAN = "一-龥"  # U+4E00 to U+9FA5
SENTENCE_END = "[\r\n﹔﹖﹗。！？?!;；]+[\"’”]{0,2}|……[\"’”“‘]?"
#: The same with a full stop, for Latin scripts.
SENTENCE_END_LATIN = "[.\r\n﹔﹖﹗。！？?!;；]+[\"’”]{0,2}|……[\"’”“‘]?"
PARAGRAPH = " {6}"
FULL_WIDTH = "".join(map(chr, [0x3000, *range(0xFF01, 0xFF5F)]))
HALF_WIDTH = "".join(map(chr, range(0x20, 0x7F)))
# What plain punctuation replaces.
PLAIN_FROM = "¨─╔╝゛`～！，；？﹖：（）【〔】〕「」‘’『』“”\t\n　"
PLAIN_TO = "\"-\"\"\"'~!,;??:()(())\"\"''《》\"\"。。 "
EXEMPT_RIGHT = ("他", "她", "之", "阿", "呀")


def character_class(chars: str) -> str:
    """A regular expression class of exactly these characters."""
    return "[" + "".join("\\" + c if c in r"\[]^-&~|" else c for c in chars) + "]"


def clean(text: Column) -> Column:
    """Tabs, line ends, no-break and ideographic spaces become spaces."""
    return F.translate(text, "\t\r\n 　", "     ")


def without_spaces(text: Column, wide: bool = False) -> Column:
    """Without spaces; with `wide`, without ideographic spaces too."""
    return F.translate(text, " 　" if wide else " ", "")


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def full_width(text: Column) -> Column:
    return F.translate(text, HALF_WIDTH, FULL_WIDTH)


def uniform(text: Column) -> Column:
    """Half width, lower case."""
    return F.lower(half_width(text))


def uniform_stops(text: Column) -> Column:
    """Each run of stops becomes a comma; of the rest only Han characters stay."""
    return F.regexp_replace(F.regexp_replace(text, character_class(STOPS) + "+", ","), f"[^{HAN},]", "")


def plain_punctuation(text: Column) -> Column:
    """Typographic punctuation by plain, tabs and line ends by stops, runs of space, stop, ! and ? by one of them, trimmed."""
    out = F.translate(F.translate(text, PLAIN_FROM, PLAIN_TO), "", "")
    for run, one in ((" {2,}", " "), ("。{2,}", "。"), ("!{2,}", "!"), (r"\?{2,}", "?")):
        out = F.regexp_replace(out, run, one)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def strip_last_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, character_class(PUNCTUATION) + "+$", "")


#: What remove_punctuation() leaves out beside white space of every kind: of PUNCTUATION what ends or cuts a sentence, with @ # ~ ￥.
SENTENCE_PUNCTUATION = "+.!/<>“”,$%^*(\"'—！，。？、~@#￥…&（）"


def remove_punctuation(text: Column) -> Column:
    """Without white space (ideographic and no-break spaces too), ASCII and Chinese sentence punctuation."""
    return F.regexp_replace(text, "[" + character_class(SENTENCE_PUNCTUATION)[1:-1] + r"\s\x{85}\p{Z}]", "")


def same_but_punctuation(a: Column, b: Column) -> Column:
    return F.translate(a, PUNCTUATION, "") == F.translate(b, PUNCTUATION, "")


def is_punctuation(word: Column) -> Column:
    """The word stands in the punctuation string, as a whole: runs such as …… and () count, and so does the empty word."""
    return F.contains(F.lit(PUNCTUATION), word)


def is_han(text: Column) -> Column:
    """Only Han characters; true for the empty text."""
    return F.regexp(text, F.lit(rf"^[{HAN}]*\z"))


def is_number(text: Column) -> Column:
    return F.regexp(text, F.lit(r"^[0-9]+\z"))


def is_alphabet(text: Column) -> Column:
    return F.regexp(text, F.lit(r"^[A-Za-z]+\z"))


def is_other(text: Column) -> Column:
    """Neither Han nor digits nor Latin letters, by intent; every single character is in one class."""
    return ~(is_han(text) | is_number(text) | is_alphabet(text))


def foreign_share(text: Column, own: str = HAN) -> Column:
    """Share of the characters outside the class `own`; null for the empty text."""
    return F.length(F.regexp_replace(text, f"[{own}]", "")) / F.nullif(F.length(text), F.lit(0))


def valid_sentence(text: Column, own: str = HAN, most: float = 0.7) -> Column:
    """Not blank, and at most `most` of its characters outside the class `own`."""
    return F.coalesce(F.regexp(text, F.lit(r"\S")) & (foreign_share(text, own) <= most), F.lit(False))


def word_count(text: Column) -> Column:
    return F.length(text)


def total_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))


def cut_content(text: Column, chars: int, paragraphs: int, separator: str = " " * 6) -> Column:
    """The first so many characters, and of these the first so many paragraphs, trimmed."""
    return F.trim(F.array_join(F.slice(F.split(F.substring(text, 1, chars), separator, -1), 1, paragraphs), separator))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def local_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.from_utc_timestamp(ts, zone)


def printable(text: Column) -> Column:
    """Without control and format characters and U+FFFD; every white space a space."""
    return F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]|\p{Zs}", " "), r"[\x00�]|\p{Cc}|\p{Cf}", "")


def is_space(ch: Column) -> Column:
    return F.regexp(ch, F.lit(r"^(?:[ \t\n\r]|\p{Zs})$"))


def is_control(ch: Column) -> Column:
    return F.regexp(ch, F.lit(r"^(?:[\p{Cc}\p{Cf}&&[^\t\n\r]])$"))


def is_any_punctuation(ch: Column) -> Column:
    """ASCII characters that are neither letters, digits, space nor control, and all Unicode punctuation."""
    return F.regexp(ch, F.lit(r"^(?:[!-/:-@\[-`{-~]|\p{P})$"))


def is_cjk(ch: Column) -> Column:
    """In one of the CJK ideograph blocks."""
    return F.regexp(ch, F.lit(r"^[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]$"))
