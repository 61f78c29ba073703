"""Secret scan with multipart credential linking, in native expressions only.

Three base kinds are reported wherever they match. Weak candidates (an account identifier, a random-looking string, an
endpoint) are common in clean text, so each is a mere candidate until an interval join within its scope finds the parts
that complete a credential. Both sides of that join are arrays of one row, so it needs neither shuffle nor key, no document
can be skewed against another, and repeated or null ids are no trouble.

Positions come from two views of the same matches: regexp_extract_all gives them in order, split() the gaps between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let, running

# The patterns of the base kinds, with the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

# The patterns of the weak kinds.
ACCOUNT = r"""(?i:(?:client_?id|user(?:name)?|login|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i:[a-z][a-z0-9+]{1,15})://[^\x00-\x20"'<>]+"""
WEAK = ("account", "opaque", "endpoint")

#: Code points between two spans that are still in one scope.
SCOPE = 200

SPAN = "array<struct<s:bigint,e:bigint>>"


def located(text: Column, pattern: str, counts: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, [] where there is none; `counts` says of a group's text whether its match counts."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m).cast("bigint"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    if counts is None:
        sized = F.transform(whole, lambda w: F.struct(w.alias("w"), F.lit(True).alias("ok")))
    else:
        sized = F.zip_with(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda w, m: F.struct(w.alias("w"), counts(m).alias("ok")))

    def spans(found: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + m["w"]), lambda a, b: a + b)
        all_spans = F.zip_with(ends, found, lambda e, m: F.struct((e - m["w"]).alias("s"), e.alias("e"), m["ok"].alias("ok")))
        return F.transform(F.filter(all_spans, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return F.when(F.regexp(text, F.lit(pattern)), let(sized, spans)).otherwise(F.array().cast(SPAN))


def beside(spans: Column, others: list[Column], reach: int, wanted: bool = True) -> Column:
    """The spans that have one of `others` within `reach` code points of them, or with wanted=False those that have none; reach -1 is overlap.

    An interval join of sorted sides: spans by where their reach ends are merged with others by where they begin. Some other
    span is in reach if the furthest end of all that begin before the reach ends isn't before where the reach begins.
    """
    marks = F.transform(F.concat(*others), lambda o: F.struct(o["s"].alias("at"), F.lit(0).alias("kind"), o["s"].alias("s"), o["e"].alias("e"), o["e"].alias("furthest")))
    probes = F.transform(spans, lambda x: F.struct((x["e"] + reach).alias("at"), F.lit(1).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(-(1 << 40)).cast("bigint").alias("furthest")))

    def met(events: Column) -> Column:
        furthest = running(F.transform(events, lambda v: v["furthest"]), lambda a, b: F.greatest(a, b))
        seen = F.zip_with(events, furthest, lambda v, f: F.struct(v["kind"].alias("kind"), v["s"].alias("s"), v["e"].alias("e"), (f >= v["s"] - reach).alias("near")))
        return F.transform(F.filter(seen, lambda v: (v["kind"] == 1) & (v["near"] == F.lit(wanted))), lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e")))

    return F.when(F.size(spans) > 0, let(F.sort_array(F.concat(marks, probes)), met)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with a column for each kind: an array of spans (s, e), code points, end exclusive.

    A weak candidate is kept only beside complementary parts within `scope` code points: an account beside a secret (assign,
    hex or opaque); an opaque string beside an identifier (access or account); an endpoint beside an identifier and a
    secret. A weak candidate over a base span is that span's, and is dropped. Null and empty texts have no spans; repeated
    rows are scanned each; time grows as n log n with the matches of a text. Other columns pass through; a column that has a
    kind's name is overwritten.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda m: F.length(m) >= ASSIGN_LEAST
    out = docs.withColumns({"assign": located(t, ASSIGN, long_enough, 2), "access": located(t, ACCESS), "hex": located(t, HEX), "_account": located(t, ACCOUNT), "_endpoint": located(t, ENDPOINT)})
    base = [F.col(k) for k in BASE]
    # an opaque string matters beside an identifier only, so texts without one need no search for it
    ids = (F.size("access") > 0) | (F.size("_account") > 0)
    mixed = located(t, OPAQUE, lambda m: F.regexp(m, F.lit("[0-9]")) & F.regexp(m, F.lit("[A-Z]")) & F.regexp(m, F.lit("[a-z]")))
    out = out.withColumn("_opaque", F.when(ids, mixed).otherwise(F.array().cast(SPAN)))
    out = out.withColumn("_opaque", beside(F.col("_opaque"), [*base, F.col("_endpoint")], -1, False))
    opaque = F.col("_opaque")
    secrets, identifiers = [F.col("assign"), F.col("hex"), opaque], [F.col("access"), F.col("_account")]
    linked = {
        "account": beside(beside(F.col("_account"), base, -1, False), secrets, scope),
        "opaque": beside(opaque, identifiers, scope),
        "endpoint": beside(beside(F.col("_endpoint"), secrets, scope), identifiers, scope),
    }
    return out.withColumns(linked).drop("_account", "_opaque", "_endpoint")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind in the order given, comma-joined."""

    def tagged(i: int) -> Column:
        return F.transform(F.col(kinds[i]), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*map(tagged, range(len(kinds))))), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    found = scan(docs)
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE).cast("binary"), 256).alias("base_sha256"),
        listed(BASE + WEAK).alias("spans"),
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in WEAK],
    )
