"""Typo detection on clauses: candidates by joins with lexicons, one batch of model scores, and a cascade over the scored candidates.

A candidate's score depends on the original clause only, so the candidates of all detectors are made and scored as one table.
What is sequential, which candidate is taken and what that hides from later detectors, runs over the few candidates of one
clause at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.lookups import lookup, windows

KEY = ["doc_id", "sno", "clause"]
# Error types.
IDIOM, NONWORD, NONWORD_NEAR, CHAR, CHAR_NEAR, WORD, WORD_NEAR, WORD_MODEL, CHAR_MODEL, NAME, NAME_RECALL = 0, 1, 51, 2, 52, 3, 4, 5, 6, 7, 57
MULTI, ENTITY, FIXED, BESIDE, MULTI_MODEL, BESIDE_MODEL, NEURAL, SPLIT, LABEL, PRONOUN, NEURAL_MODEL = 8, 9, 10, 11, 12, 13, 17, 19, 20, 23, 22
#: Types that don't close the gate for later detectors.
EARLY = {IDIOM, FIXED, NAME, ENTITY}
# Least words of a clause, and ratios below which a candidate is taken, in titles and bodies.
LEAST = {"nonword": 3, "char": 4, "multi": 4, "beside": 4, "word": 5}
TAKEN = {"char": (0.1, 0.5), "same": (0.36, 0.4), "near": (0.33, 0.5), "beside": (0.1, 0.5)}
NONWORD_BELOW, NONWORD_NEAR_BELOW, SPLIT_BELOW, SPLIT_SUSPECT, FIXED_BELOW = 0.7, 0.5, 0.1, 0.15, 1.0
CANDIDATE = "det string, b int, e int, cand string, at int, pref int, rank int, rule string"


def suspect_below(words: int) -> float:
    """The ratio below which a candidate that isn't taken makes the sentence a suspect."""
    return 0.9 if 23 < words <= 30 else 0.8


def clause_rows(sentences: DataFrame, known: Column | None = None) -> DataFrame:
    """Clauses of sentences (doc_id, sno, para, data_type, words, flags): words, idx, offs, flags, punc, norm, to_norm.

    flags: 1 to check, 0 settled, below 0 protected. punc: 0 punctuation, 1 Han in the vocabulary, 2 not Han, -1 Han beyond
    it. known: a boolean of an element, a function of a word column. norm: the words but punctuation.
    """
    from quillspark.operators.split import clauses_of

    out = sentences.withColumn("_c", clauses_of(F.col("words"))).select(*sentences.columns, F.posexplode("_c").alias("clause", "_w"))
    in_vocabulary = known or (lambda w: F.lit(True))
    punc = F.transform("_w", lambda x: F.when(T.is_punctuation(x["word"]), 0).when(~T.is_han(x["word"]), 2).when(in_vocabulary(x["word"]), 1).otherwise(-1))
    flags = F.transform("_w", lambda x: F.get(F.col("flags"), x["idx"]))
    out = out.withColumns({"words": F.transform("_w", lambda x: x["word"]), "idx": F.transform("_w", lambda x: x["idx"]), "offs": F.transform("_w", lambda x: x["off"]), "flags": flags, "punc": punc}).drop("_w")
    protected = protected_words(F.col("words"), F.col("offs"))
    out = out.withColumn("flags", F.zip_with("flags", protected, lambda f, p: F.when(p, F.lit(-4)).otherwise(f)))
    out = out.withColumn("norm", F.filter("words", lambda w, i: F.get(F.col("punc"), i) != 0))
    return out.withColumn("to_norm", F.transform("words", lambda _, i: F.size(F.filter(F.slice("punc", F.lit(1), i), lambda p: p != 0))))


def protected_words(words: Column, offs: Column) -> Column:
    """Which words stand between paired quotes or brackets of one clause."""
    from quillspark.operators.split import delimited

    joined = F.array_join(words, "")
    first = F.element_at(offs, 1)
    quoted = delimited(joined)

    def inside(off: Column) -> Column:
        at = off - first
        return F.exists(quoted, lambda q: (F.instr(joined, q) - 1 <= at) & (at < F.instr(joined, q) - 1 + F.length(q)))

    return F.transform(offs, inside)


def passed_windows(clauses: DataFrame, pass_words: Column) -> DataFrame:
    """clauses whose flags are 0 for windows of 4 to 2 words to be checked that make a listed word of 4 characters at most."""
    hit = F.filter(windows(F.col("words"), 2, 4), lambda w: (F.length(F.array_join(w["words"], "")) <= 4) & F.array_contains(pass_words, F.array_join(w["words"], "")) & F.forall(F.slice("flags", w["begin"] + 1, w["n"]), lambda f: f == 1) & F.forall(F.slice("punc", w["begin"] + 1, w["n"]), lambda p: p > 0))
    free = F.transform("flags", lambda f, i: F.when(F.exists(F.col("_hit"), lambda w: (w["begin"] <= i) & (i < w["begin"] + w["n"])), F.lit(0)).otherwise(f))
    return clauses.withColumn("_hit", hit).withColumn("flags", free).drop("_hit")


# --- candidates: rows of KEY, det, b, e, cand (words parted by spaces), at (the anchor), pref (of the anchor's lists), rank, rule


@dataclass
class Lexicons:
    """Tables; whichever is None, its detector finds nothing."""

    readings: Column | None = None  # a map of characters to readings without tones: the key that homophones share
    tones: dict[str, str] = field(default_factory=dict)  # characters to readings with tones: what tells two homophones apart
    idioms: DataFrame | None = None  # py, word, rank
    same_sound: DataFrame | None = None  # word, cand, rank
    near_chars: DataFrame | None = None  # word, cand, rank
    near_words: DataFrame | None = None  # word, cand, rank
    common: DataFrame | None = None  # py, word, rank
    fixed: DataFrame | None = None  # side, anchor, py, cand, rank
    beside_ok: DataFrame | None = None  # key, value
    beside: DataFrame | None = None  # key, value, rank
    split: DataFrame | None = None  # key, value, rank
    top_words: DataFrame | None = None  # word
    frequent_words: DataFrame | None = None  # word
    pass_chars: set[str] = field(default_factory=set)
    pass_words: set[str] = field(default_factory=set)
    sure_chars: set[str] = field(default_factory=set)  # homophones only are tried for these
    similar: set[tuple[str, str]] = field(default_factory=set)  # pairs of words of close meaning


def _py(words: Column, readings: Column, by: str = " ") -> Column:
    return F.array_join(F.transform(F.split(F.array_join(words, ""), ""), lambda c: F.coalesce(F.try_element_at(readings, c), c)), by)


def _anchors(clauses: DataFrame) -> DataFrame:
    """One row a word: j, w, flag, p, and its neighbours with theirs; run: it is one of two or more single Han characters in a row."""
    single = F.transform("words", lambda w: (F.length(w) == 1) & T.is_han(w))
    rows = clauses.withColumn("_s", single).select(*KEY, "words", "flags", "punc", "_s", F.posexplode("words").alias("j", "w"))
    get = lambda c, d: F.get(F.col(c), F.col("j") + d)
    return rows.select(
        *KEY, "words", "flags", "punc", "j", "w", get("flags", 0).alias("flag"), get("punc", 0).alias("p"), get("_s", 0).alias("single"),
        *[F.when(F.col("j") + d >= 0, get(c, d)).alias(f"{name}_{c}") for name, d in (("left", -1), ("right", 1)) for c in ("words", "flags", "punc", "_s")],
    ).withColumn("run", F.col("single") & (F.coalesce("left__s", F.lit(False)) | F.coalesce("right__s", F.lit(False))))


def entity_spans(clauses: DataFrame) -> DataFrame:
    """KEY, j, word, last, span: each protected Han word of a clause, and the text from it to the last word before one that is to be checked or punctuation."""
    protected = F.col("flag") < 0
    ends = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (k > F.col("j")) & ((F.get("flags", k) > 0) | (F.get("punc", k) == 0)))
    rows = clauses.select(*KEY, "words", "flags", "punc", F.posexplode("words").alias("j", "word")).withColumns({"flag": F.get("flags", F.col("j")), "p": F.get("punc", F.col("j"))})
    rows = rows.filter(protected & T.is_han(F.col("word")) & ~F.col("p").isin(0, 2)).withColumn("last", F.coalesce(F.array_min(ends) - 1, F.size("words") - 1))
    return rows.select(*KEY, "j", "word", "last", F.array_join(F.slice("words", F.col("j") + 1, F.col("last") - F.col("j") + 1), "").alias("span"))


def _rows(df: DataFrame, det: str, b: Column, e: Column, cand: Column, at: Column, pref: Column, rank: Column, rule: Column | None = None) -> DataFrame:
    return df.select(*KEY, F.lit(det).alias("det"), b.cast("int").alias("b"), e.cast("int").alias("e"), cand.alias("cand"), at.cast("int").alias("at"), pref.cast("int").alias("pref"), rank.cast("int").alias("rank"), (rule if rule is not None else F.lit("")).alias("rule"))


def candidates(clauses: DataFrame, lex: Lexicons, names: DataFrame | None = None) -> DataFrame:
    """The candidates of all detectors. names: doc_id, word, rule, right of the document's entity errors."""
    parts: list[DataFrame] = []
    a, zero = _anchors(clauses), F.lit(0)
    if lex.readings is not None:
        wins = clauses.select(*KEY, "words", "flags", "punc", "offs", F.explode(windows(F.col("words"), 1, 4)).alias("w")).select(*KEY, "words", "flags", "punc", "offs", F.col("w.begin").alias("b"), F.col("w.n").alias("n"), F.col("w.words").alias("ws"))
        e = F.col("b") + F.col("n") - 1
        plain = F.forall(F.slice("punc", F.col("b") + 1, F.col("n")), lambda p: ~p.isin(0, 2))
        if lex.idioms is not None:
            four = wins.filter((F.col("n") > 1) & (F.length(F.array_join("ws", "")) == 4) & F.exists("ws", lambda x: F.length(x) == 1) & plain & (F.get("flags", F.col("b")) > 0))
            four = four.filter(F.get("offs", e) + F.length(F.element_at("ws", -1)) - F.get("offs", F.col("b")) == 4).withColumn("py", _py(F.col("ws"), lex.readings))
            found = lookup(four.withColumn("text", F.array_join("ws", "")), lex.idioms.select("py", F.col("word").alias("idiom"), "rank"), {"py": "py"})
            listed = found.filter("text = idiom").select(*KEY, "b").distinct()
            found = found.join(listed, [*KEY, "b"], "left_anti")
            parts.append(_rows(found, "idiom", F.col("b"), e, F.col("idiom"), F.col("b"), zero, F.col("rank")))
        if lex.fixed is not None:
            good = F.forall(F.slice("flags", F.col("b") + 1, F.col("n")), lambda f: f == 1) & F.forall(F.slice("punc", F.col("b") + 1, F.col("n")), lambda p: p != 0)
            frag = wins.filter((F.col("n") <= 3) & good).withColumns({"py": _py(F.col("ws"), lex.readings), "seg": F.array_join("ws", "/")})
            for pref, side, j in ((0, "head", F.col("b") - 1), (1, "tail", F.col("b") + F.col("n"))):
                f = frag.withColumn("j", j).filter((F.col("j") >= 0) & (F.col("j") < F.size("words"))).withColumns({"anchor": F.get("words", F.col("j")), "side": F.lit(side)})
                f = f.filter((F.get("flags", F.col("j")) > 0) & (F.get("punc", F.col("j")) > 0))
                found = lookup(f, lex.fixed, {"side": "side", "anchor": "anchor", "py": "py"})
                kept = found.join(found.filter("seg = cand").select(*KEY, "b", "n", "j").distinct(), [*KEY, "b", "n", "j"], "left_anti")
                parts.append(_rows(kept, "fixed", F.col("b"), F.col("b") + F.col("n") - 1, F.translate("cand", "/", " "), F.col("j"), F.lit(pref), F.col("n") * 1000 + F.col("rank")))
        if lex.common is not None:
            two = a.filter("run and coalesce(right__s, false) and flag > 0 and p not in (0, 2)").withColumn("py", _py(F.array("w", "right_words"), lex.readings))
            found = lookup(two, lex.common.select("py", F.col("word").alias("cand"), "rank"), {"py": "py"})
            parts.append(_rows(found, "multi", F.col("j"), F.col("j") + 1, F.col("cand"), F.col("j"), zero, F.col("rank")))
        if lex.beside is not None:
            run = a.filter("run and flag > 0 and p > 0")
            keyed = run.withColumns({"left_key": F.when(F.col("left__s"), F.concat("left_words", F.lit("+1"))), "right_key": F.when(F.col("right__s"), F.concat("right_words", F.lit("-1")))})
            if lex.beside_ok is not None:
                for key in ("left_key", "right_key"):
                    keyed = lookup(keyed, lex.beside_ok.select("key", F.col("value").alias("ok")), {key: "key", "w": "ok"}, "left_anti")
            first = F.substring(F.coalesce(F.try_element_at(lex.readings, F.col("w")), F.col("w")), 1, 1)
            other = F.substring(F.coalesce(F.try_element_at(lex.readings, F.col("value")), F.col("value")), 1, 1)
            for pref, key, side in ((0, "left_key", "left"), (1, "right_key", "right")):
                found = lookup(keyed.filter(F.col(f"{side}_punc") > 0), lex.beside.select("key", "value", "rank"), {key: "key"}).filter(first == other)
                begin = F.col("j") - 1 if side == "left" else F.col("j")
                cand = F.concat("left_words", "value") if side == "left" else F.concat("value", "right_words")
                parts.append(_rows(found, "beside", begin, begin + 1, cand, F.col("j"), F.lit(pref), F.col("rank")))
    to_check = a.filter("flag > 0")
    for source, near, members in ((lex.same_sound, 0, lex.top_words), (lex.near_chars, 1, lex.frequent_words)):
        if source is None:
            continue
        found = lookup(to_check, source.select(F.col("word").alias("_from"), "cand", "rank"), {"w": "_from"})
        if members is not None:
            run = found.filter("run and p > 0")
            for pref, side in ((1, "right"), (2, "left")):
                pair = F.concat("cand", "right_words") if side == "right" else F.concat("left_words", "cand")
                joined = run.filter(F.col(f"{side}_words").isNotNull() & (F.col(f"{side}_flags") > 0) & (F.col(f"{side}_punc") > 0)).withColumn("pair", pair)
                hit = lookup(joined, members.select(F.col("word").alias("_m")), {"pair": "_m"}, "left_semi")
                begin = F.col("j") if side == "right" else F.col("j") - 1
                parts.append(_rows(hit, "nonword_near" if near else "nonword", begin, begin + 1, F.col("pair"), F.col("j"), F.lit(pref), F.col("rank")))
        parts.append(_rows(found.filter("single and p > 0"), "char_near" if near else "char", F.col("j"), F.col("j"), F.col("cand"), F.col("j"), F.lit(near), F.col("rank")))
    for source, near in ((lex.same_sound, 0), (lex.near_words, 1)):
        if source is not None:
            long = to_check.filter((F.length("w") > 1) & (F.col("p") == 1) & T.is_han(F.col("w")))
            found = lookup(long, source.select(F.col("word").alias("_from"), "cand", "rank"), {"w": "_from"})
            parts.append(_rows(found, "word_near" if near else "word", F.col("j"), F.col("j"), F.col("cand"), F.col("j"), F.lit(near), F.col("rank")))
    if lex.split is not None:
        found = lookup(to_check.filter((F.col("p") == 1) & (F.length("w") > 1)), lex.split.select(F.col("key").alias("_from"), F.col("value").alias("cand"), "rank"), {"w": "_from"})
        parts.append(_rows(found, "split", F.col("j"), F.col("j"), F.translate("cand", "/", " "), F.col("j"), zero, F.col("rank")))
    if names is not None:
        person = F.startswith(F.col("rule"), F.lit("7"))
        wanted = names.filter((F.length("word") == F.length("right")) & (F.col("word") != F.col("right"))).select("doc_id", F.col("word").alias("w"), F.col("rule").alias("r"), "right", person.alias("person"))
        spans = entity_spans(clauses)
        # a person is one word; another entity is all protected words from one on, up to a word to be checked or punctuation
        one = spans.select(*KEY, "j", F.col("j").alias("last"), F.col("word").alias("w")).join(wanted.filter("person"), ["doc_id", "w"])
        many = spans.join(wanted.filter("person").select("doc_id", F.col("w").alias("word")), ["doc_id", "word"], "left_anti")
        many = many.select(*KEY, "j", "last", F.col("span").alias("w")).join(wanted.filter("not person"), ["doc_id", "w"])
        for found in (one, many):
            parts.append(_rows(found, "name", F.col("j"), F.col("last"), F.col("right"), F.col("j"), zero, zero, F.col("r")))
    if lex.top_words is not None:  # characters that make a listed word with a neighbour are settled before they are tried
        run = a.filter("run and flag > 0 and p > 0")
        for side in ("right", "left"):
            pair = F.concat("w", "right_words") if side == "right" else F.concat("left_words", "w")
            settled = lookup(run.filter(F.col(f"{side}_words").isNotNull()).withColumn("pair", pair), lex.top_words.select(F.col("word").alias("_m")), {"pair": "_m"}, "left_semi")
            parts.append(_rows(settled, "settled", F.col("j"), F.col("j"), F.lit(""), F.col("j"), zero, zero))
    if not parts:
        return clauses.sparkSession.createDataFrame([], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in clauses.schema if f.name in KEY)}, {CANDIDATE}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored(clauses: DataFrame, cands: DataFrame, ppl: Callable[[Column], Column]) -> DataFrame:
    """clauses with raw_ppl and cands: all its candidates with their ratio of perplexities.

    ratio is 1 where the candidate is the same text or of another length, and null where there is nothing to compare.
    Equal replacements of a clause are scored once.
    """
    raw = clauses.withColumn("raw_ppl", F.when(F.size("norm") > 0, ppl(F.col("norm"))))
    rows = cands.join(raw.select(*KEY, "words", "norm", "to_norm", "raw_ppl"), KEY)
    first, last = F.get("to_norm", F.col("b")), F.get("to_norm", F.col("e"))
    center = F.split("cand", " ")
    old = F.array_join(F.slice("words", F.col("b") + 1, F.col("e") - F.col("b") + 1), "")
    comparable = (F.col("det") != "settled") & (old != F.array_join(center, "")) & (F.length(old) == F.length(F.array_join(center, ""))) & (F.col("raw_ppl") > 0)
    rows = rows.withColumns({"_ok": comparable, "_new": F.concat(F.slice("norm", F.lit(1), first), center, F.slice("norm", last + 2, F.size("norm")))})
    unique = rows.filter("_ok").select(*KEY, "_new", "raw_ppl").distinct()
    ratios = unique.withColumn("ratio", ppl(F.col("_new")) / F.col("raw_ppl")).drop("raw_ppl")
    rows = rows.join(ratios, [*KEY, "_new"], "left").withColumn("ratio", F.when(F.col("_ok"), F.col("ratio")).otherwise(F.lit(1.0)))
    listed = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("det", "at", "pref", "rank", "b", "e", "cand", "rule", "ratio"))).alias("cands"))
    return raw.join(listed, KEY, "left")


# --- the cascade


class Cascade:
    """The candidates of one clause, taken detector by detector."""

    def __init__(self, clause: dict, lex_chars: set[str], lex_words: set[str], sure: set[str], similar: set[tuple[str, str]], tones: dict[str, str]):
        self.c, self.flags, self.taken, self.asked = clause, [int(f) for f in clause["flags"]], [], False
        self.pass_chars, self.pass_words, self.sure, self.similar, self.tones = lex_chars, lex_words, sure, similar, tones
        self.by: dict[str, list] = {}
        for x in [] if clause["cands"] is None else clause["cands"]:
            self.by.setdefault(x["det"], []).append(x)
        self.names = set([] if clause.get("all_names") is None else clause["all_names"])
        self.suspect_ratio = suspect_below(len(clause["norm"]))
        self.title = clause["sno"] == 0

    def old(self, x: dict) -> str:
        return "".join(self.c["words"][x["b"] : x["e"] + 1])

    def settle(self, x: dict) -> None:
        for i in range(x["b"], x["e"] + 1):
            self.flags[i] = 0

    def take(self, x: dict, kind: int, prob: float) -> None:
        self.taken.append({"b": x["b"], "e": x["e"], "right": x["cand"].replace(" ", ""), "type": kind, "prob": prob})

    def exempt(self, kind: int, wrong: str, right: str) -> bool:
        if kind in (NONWORD, NONWORD_NEAR):
            if len(wrong) == len(right) == 2 and (wrong[0] == right[0]) != (wrong[1] == right[1]):
                wrong = wrong[1] if wrong[0] == right[0] else wrong[0]
            return wrong in self.pass_chars
        if kind in (CHAR, CHAR_NEAR, CHAR_MODEL):
            return wrong in self.pass_chars or right in T.EXEMPT_RIGHT
        if kind in (WORD, WORD_NEAR, WORD_MODEL) and len(wrong) > 1:
            return wrong in self.names or wrong in self.pass_words or wrong[-1] in "哥姐氏妃" or wrong[0] == "小"
        return False

    def accept(self, x: dict, kind: int, prob: float | None = None) -> None:
        """Settles the words; a candidate that is exempt settles them too, but isn't reported."""
        if not self.exempt(kind, self.old(x), x["cand"].replace(" ", "")):
            self.take(x, kind, 1 - x["ratio"] if prob is None else prob)
        self.settle(x)

    @property
    def gate(self) -> bool:
        return all(t["type"] in EARLY for t in self.taken)

    def escalate(self, suspects: list[dict], kind: int) -> None:
        """The suspect with the largest decrease is taken if the sentence labeller, which is asked now, says that the sentence is wrong."""
        self.asked = self.asked or bool(suspects)
        if suspects and self.c.get("judged_wrong"):
            self.accept(min(suspects, key=lambda x: x["ratio"]), kind)  # min takes the first of equals

    def anchors(self, *dets: str) -> Iterator[tuple[int, list[dict]]]:
        found = sorted((x for d in dets for x in self.by.get(d, [])), key=lambda x: (x["at"], x["pref"] if dets[0] != "nonword" else 0, x["rank"], x["pref"]))
        for at in sorted({x["at"] for x in found}):
            yield at, [x for x in found if x["at"] == at]

    def idioms(self) -> None:
        for at, xs in self.anchors("idiom"):
            if self.flags[at] <= 0:
                continue
            for x in xs:
                wrong, right = self.old(x), x["cand"]
                differ = [i for i in range(4) if wrong[i] != right[i]]
                tones = any(self.tones.get(a, a) != self.tones.get(b, b) for a, b in zip(wrong, right, strict=True))
                if len(differ) == 1 or (len(differ) == 2 and not (x["ratio"] > 1 and tones)):
                    self.settle(x)
                    self.take(x, IDIOM, 1 - x["ratio"])
                    break

    def entities(self) -> None:
        for at, xs in self.anchors("name"):
            for x in xs[:1]:
                person = x["rule"].startswith("7")
                kind = (NAME_RECALL if x["rule"] == "7_baidu" or self.old(x)[-1] in "哥姐" else NAME) if person else ENTITY
                self.settle(x)
                self.take(x, kind, 1.0)

    def fixed(self) -> None:
        for at, xs in self.anchors("fixed"):
            if self.flags[at] <= 0:
                continue
            sides = [next((x for x in xs if x["pref"] == side and x["ratio"] < FIXED_BELOW), None) for side in (0, 1)]
            hits = [x for x in sides if x]
            if hits:
                x = min(hits, key=lambda x: x["ratio"])
                self.settle(x)
                self.take(x, FIXED, 1 - x["ratio"])
                return

    def nonwords(self) -> None:
        if len(self.c["norm"]) < LEAST["nonword"]:
            return
        settled = {x["at"] for x in self.by.get("settled", [])}
        same, near = dict(self.anchors("nonword")), dict(self.anchors("nonword_near"))
        for at in sorted(settled | set(same) | set(near)):
            if self.flags[at] <= 0 or self.c["punc"][at] <= 0:
                continue
            sure = self.c["words"][at] in self.sure
            if at in settled and not sure:
                self.flags[at] = 0
                continue
            for xs, below, kind in ((same.get(at, []), NONWORD_BELOW, NONWORD), ([] if sure else near.get(at, []), NONWORD_NEAR_BELOW, NONWORD_NEAR)):
                x = next((x for x in xs if x["ratio"] < below and all(self.flags[i] > 0 for i in (x["b"], x["e"]))), None)
                if x:
                    self.accept(x, kind)
                    break

    def chars(self) -> None:
        if len(self.c["norm"]) < LEAST["char"]:
            return
        suspects = []
        for at, xs in self.anchors("char", "char_near"):
            if self.flags[at] <= 0:
                continue
            for x in xs:
                if x["det"] == "char" and x["ratio"] < TAKEN["char"][not self.title]:
                    self.accept(x, CHAR)
                    return
                if x["ratio"] < self.suspect_ratio:
                    suspects.append(x)
        self.escalate(suspects, CHAR_MODEL)

    def words(self) -> None:
        if len(self.c["norm"]) < LEAST["word"]:
            return
        suspects = []
        for at, xs in self.anchors("word", "word_near"):
            if self.flags[at] <= 0:
                continue
            for x in xs:
                name, kind = ("same", WORD) if x["det"] == "word" else ("near", WORD_NEAR)
                if x["ratio"] < TAKEN[name][not self.title]:
                    if (self.old(x), x["cand"]) in self.similar:
                        continue
                    self.accept(x, kind)
                    return
                if x["ratio"] < self.suspect_ratio:
                    suspects.append(x)
        self.escalate(suspects, WORD_MODEL)

    def multi(self) -> None:
        if len(self.c["norm"]) >= LEAST["multi"]:
            self.escalate([x for at, xs in self.anchors("multi") if self.flags[at] > 0 for x in xs if x["ratio"] < self.suspect_ratio], MULTI_MODEL)

    def beside(self) -> None:
        if len(self.c["norm"]) < LEAST["beside"]:
            return
        suspects = []
        for at, xs in self.anchors("beside"):
            if self.flags[at] <= 0:
                continue
            for x in xs:
                if x["ratio"] < TAKEN["beside"][not self.title]:
                    self.accept(x, BESIDE)
                    return
                if x["ratio"] < self.suspect_ratio:
                    suspects.append(x)
        self.escalate(suspects, BESIDE_MODEL)

    def split(self) -> None:
        suspects = []
        for at, xs in self.anchors("split"):
            if self.flags[at] <= 0:
                continue
            for x in xs:
                if x["ratio"] < SPLIT_BELOW:
                    self.accept(x, SPLIT)
                    break
                if x["ratio"] < SPLIT_SUSPECT:
                    suspects.append(x)
        self.escalate(suspects, SPLIT)

    def run(self, neural: Callable[[dict], list[dict]] | None = None) -> list[dict]:
        self.idioms()
        self.entities()
        self.fixed()
        self.nonwords()
        for step in (self.chars, self.words, self.multi, self.beside):
            if self.gate:
                step()
        if neural and self.title and not self.taken:
            hits = neural(self.c)  # b, e, cand, ratio and sure
            for x in hits:
                if x["sure"]:
                    self.accept(x, NEURAL, x["ratio"])
            self.escalate([x for x in hits if not x["sure"] and self.flags[x["b"]] > 0 and x["ratio"] < self.suspect_ratio], NEURAL_MODEL)
        if self.gate:
            self.split()
        return first_of_cells(self.taken)


def first_of_cells(taken: list[dict]) -> list[dict]:
    """The first candidate of every place, in the order of places."""
    cells: dict[tuple[int, int], dict] = {}
    for t in taken:
        cells.setdefault((t["b"], t["e"]), t)
    return [cells[k] for k in sorted(cells)]


def resolved(clauses: DataFrame, lex: Lexicons, neural: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """clause_errors: KEY, clause_text, wrong, right, type, prob, char_pos (of the fragment), seq (its order in the clause), asked (a suspect asked for the labeller), error (null, or why a clause failed).

    A clause whose cascade fails has a row with the reason and no errors; the job goes on. A clause that asks for the labeller
    and has no errors has a row without a type. Only clauses with candidates go to Python, or titles if there is a neural model.
    """
    clauses = clauses.filter(F.col("cands").isNotNull() | (F.lit(neural is not None) & (F.col("sno") == 0)))
    types = {f.name: f.dataType.simpleString() for f in clauses.schema}
    shape = ", ".join(f"{k} {types[k]}" for k in KEY) + ", clause_text string, wrong string, right string, type int, prob double, char_pos int, seq int, asked boolean, error string"
    chars, words, sure, similar, tones = lex.pass_chars, lex.pass_words, lex.sure_chars, lex.similar, lex.tones

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c in b.to_dict("records"):
                key, text = {k: c[k] for k in KEY}, "".join(c["words"])
                none = {**key, "clause_text": text, "wrong": None, "right": None, "type": None, "prob": None, "char_pos": None, "seq": None, "asked": False, "error": None}
                try:
                    cascade = Cascade(c, chars, words, sure, similar, tones)
                    taken = cascade.run(neural)
                    for n, t in enumerate(taken):
                        out.append({**none, "wrong": "".join(c["words"][t["b"] : t["e"] + 1]), "right": t["right"], "type": t["type"], "prob": t["prob"], "char_pos": int(c["offs"][t["b"]]), "seq": n, "asked": cascade.asked})
                    if cascade.asked and not taken:
                        out.append({**none, "asked": True})
                except Exception as e:  # one clause's fault must not end the job
                    out.append({**none, "error": f"{type(e).__name__}: {e}"[:200]})
            frame = pd.DataFrame(out, columns=[*KEY, "clause_text", "wrong", "right", "type", "prob", "char_pos", "seq", "asked", "error"])
            yield frame.astype({"type": "Int32", "char_pos": "Int32", "seq": "Int32"})

    return clauses.mapInPandas(run, shape)


def explained(clauses: DataFrame) -> DataFrame:
    """Per clause what a reader needs to follow the cascade: words, flags, perplexity, and five candidates of each detector by ratio, as JSON."""
    top = F.transform(F.array_distinct(F.transform("cands", lambda x: x["det"])), lambda d: F.struct(d.alias("det"), F.slice(F.sort_array(F.transform(F.filter("cands", lambda x: x["det"] == d), lambda x: F.struct(x["ratio"].alias("ratio"), x["b"].alias("b"), x["e"].alias("e"), x["cand"].alias("cand")))), 1, 5).alias("best")))
    return clauses.select(*KEY, F.to_json(F.struct(F.array_join("words", " ").alias("words"), "flags", "punc", "raw_ppl", top.alias("candidates"))).alias("explained"))
