"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

Two logistic models read a document's whole text: the chance that it is of low quality, and that it is toxic. Their features are
shares (of characters by kind, of repeated words and lines) and the presence of words of a vocabulary; an L1 penalty leaves few
words with weight. They are fitted on the driver to a bounded sample of the labelled rows.

Sites are levels of columns: host and path of a column url where there is one. `documents` has neither, so there a source
stands for the host and a language within it for the path. A level's mean evidence has a Beta prior around its
parent's posterior whose strength is estimated from all groups of the level (method of moments): sparse sites shrink to their
parent, and at last to the global mean. A document's posterior log odds are its own plus those by which its site's posterior
differs from the global mean. All of this is grouped aggregation: sums per site, then sums over sites.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import claim, discard, small_batches, written

#: Most labelled documents that the models are fitted to; a hash of the ids chooses them.
TRAINING_ROWS = 8_000
#: A word is in the vocabulary if so many training documents have it, it has so many bytes at most, and so many words at most are in more documents.
LEAST_DOCUMENTS, LONGEST_WORD, VOCABULARY = 5, 64, 1 << 16
#: Steps of the fit over shares alone, of that which chooses words, and of that over the chosen ones.
STEPS = 100
#: Penalty of a word's weight, in units of what chance makes the largest gradient of all words.
L1 = 0.8
#: Rejected when either posterior chance is beyond this.
REJECT = 0.5
LEVELS = ("source", "lang")
#: Bounds of a prior's strength, in documents.
STRENGTH = (2.0, 1e6)
#: Sites up to which their posteriors are broadcast; beyond that the join shuffles.
BROADCAST_SITES = 100_000

HEADS = ("low", "toxic")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
#: Lower-cases A-Z; ASCII punctuation and control characters become spaces.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else (32 if i < 128 and not chr(i).isalnum() else i) for i in range(256))


def features(text: str | None) -> tuple[list[float], set[bytes]]:
    """Shares, and the set of words."""
    raw = (text or "").encode()
    size = max(1, len(raw))
    tokens = raw.split()
    words = raw.translate(_WORDS).split()
    distinct = set(words)
    lines = raw.split(b"\n")
    shares = [raw.count(c) / size for c in (_PUNCTUATION[i : i + 1] for i in range(len(_PUNCTUATION)))]
    shares = [min(1.0, 12 * x) for x in shares]
    letters = size - len(raw.translate(None, _LETTERS))
    shares += [
        (size - len(raw.translate(None, _UPPER))) / max(1, letters),
        letters / size,
        sum(1 for c in b"0123456789" if c in raw) / 10,
        min(1.0, 12 * (size - len(raw.translate(None, b"0123456789"))) / size),
        len(distinct) / max(1, len(words)),
        len(set(lines)) / len(lines),
        min(1.0, len(words) / 50),
        min(1.0, size / max(1, len(tokens)) / 20),
        float(not words),
        sum(map(eq, tokens, tokens[1:])) / max(1, len(tokens) - 1),
        max(0, len(tokens) - len(words)) / max(1, len(tokens)),
    ]
    return shares, distinct


SHARES = len(_PUNCTUATION) + 11


@dataclass
class Model:
    """Weights of the shares and of words, and the intercepts, of both heads."""

    shares: np.ndarray
    words: dict[bytes, tuple[float, ...]]
    start: np.ndarray

    def log_odds(self, texts: Iterator[str | None]) -> np.ndarray:
        out, known = [], self.words.keys()
        for t in texts:
            shares, words = features(t)
            z = self.start + np.array(shares) @ self.shares
            for w in known & words:
                z = z + self.words[w]
            out.append(z)
        return np.array(out).reshape(-1, len(HEADS))


def fit(rows: list[tuple[list[float], bytes]], labels: np.ndarray, names: list[bytes], steps: int = STEPS, l1: float = L1) -> Model:
    """Logistic regression by proximal gradient steps that adapt to each weight.

    rows: shares, and the distinct words as 32-bit numbers in `names`. labels: a row of 0 or 1 for each head.
    """
    at = [np.frombuffer(words, np.int32) for _, words in rows]
    column = np.concatenate([*at, np.empty(0, np.int32)])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a in at])
    del at
    dense = np.array([s for s, _ in rows]).reshape(len(rows), SHARES)
    n, v = max(1, len(rows)), len(names)
    shares, weights, start = np.zeros((SHARES, len(HEADS))), np.zeros((v, len(HEADS))), np.zeros(len(HEADS))
    for h in range(len(HEADS)):
        y = labels[:, h] if len(rows) else np.empty(0)
        mean = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        b = float(np.log(mean / (1 - mean)))
        penalty = l1 * np.sqrt(mean * (1 - mean) * 2 * np.log(max(2, v)) / n * np.bincount(column, minlength=v) / n)
        if not 0 < y.sum() < len(y):  # one class only: nothing to tell apart
            start[h] = b
            continue
        w, d = np.zeros(v), np.zeros(SHARES)
        gw, gd, gb = np.full(v, 1e-8), np.full(SHARES, 1e-8), 1e-8
        # shares first, so that words explain only what shares can't; at last the words that the penalty left, without it
        for step in range(3 * steps):
            z = b + dense @ d + (np.bincount(row, w[column], len(rows)) if step > steps else 0.0)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            dd, db = dense.T @ err, err.sum()
            gd, gb = gd + dd * dd, gb + db * db
            if step >= steps:
                dw = np.bincount(column, err[row], v)
                gw += dw * dw
                rate = 0.5 / np.sqrt(gw)
                if step < 2 * steps:
                    w = w - rate * dw
                    w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
                else:
                    w = np.where(w != 0, w - rate * dw, 0.0)
            d = d - 0.5 / np.sqrt(gd) * (dd + 1e-6 * d)
            b -= 0.5 / np.sqrt(gb) * db
        shares[:, h], weights[:, h], start[h] = d, w, b
    used = np.flatnonzero(np.abs(weights).sum(axis=1))
    return Model(shares, {names[i]: tuple(weights[i]) for i in used}, start)


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fitted to `rows` labelled documents at most. docs: doc_id, text; labels: doc_id, quality (1 good), toxic (1 toxic)."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") != 1).cast("int").alias("low"), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the bound of the sample, and of the broadcast

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t) for t in b["text"]]
            words = [sorted(w for w in f[1] if len(w) <= LONGEST_WORD) for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "low": b["low"], "toxic": b["toxic"], "shares": [f[0] for f in found], "words": words})

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(read, "doc_id long, low int, toxic int, shares array<double>, words array<binary>")
    texts = written(texts.dropDuplicates(["doc_id"]), "quality-training")
    often = texts.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
    names = sorted(bytes(r["w"]) for r in often.orderBy(F.desc("n"), "w").limit(VOCABULARY).select("w").collect())  # VOCABULARY words of LONGEST_WORD bytes at most
    number = {w: i for i, w in enumerate(names)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["words"] = [np.array([i for w in x if (i := number.get(bytes(w))) is not None], np.int32).tobytes() for x in b["words"]]
            yield b

    # `rows` rows of four bytes for each word of the vocabulary at most
    got = texts.mapInPandas(numbered, "doc_id long, low int, toxic int, shares array<double>, words binary").toPandas().sort_values(["doc_id"], ignore_index=True)
    discard(texts)
    return fit([(x, bytes(w)) for x, w in zip(got["shares"], got["words"], strict=True)], got[list(HEADS)].to_numpy(float).reshape(-1, len(HEADS)), names)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def site_shifts(evidence: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """For each combination of levels, by how much each head's log odds move: columns of levels, shift_low, shift_toxic.

    evidence: the level columns and the chances p_low, p_toxic of every document.
    """
    sums = [F.count("*").alias("n"), *[F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS], *[F.sum(F.col(f"p_{h}") * F.col(f"p_{h}")).alias(f"q_{h}") for h in HEADS]]
    leaves = written(evidence.groupBy(*levels).agg(*sums), "quality-sites")
    totals = [F.sum(c).alias(c) for c in ("n", *(f"{x}_{h}" for x in "sq" for h in HEADS))]
    whole = leaves.agg(*totals).first()
    overall = {h: min(1 - 1e-6, max(1e-6, (whole[f"s_{h}"] or 0.0) / max(1, whole["n"] or 0))) for h in HEADS}
    above = None
    for depth in range(1, len(levels) + 1):
        own = list(levels[:depth])
        groups = leaves.groupBy(*own).agg(*totals)
        for h in HEADS:
            groups = groups.withColumn(f"up_{h}", F.lit(overall[h]))
        if above is not None:
            up = above.select(*[F.col(c).alias(f"_{c}") for c in own[:-1]], *[F.col(f"post_{h}").alias(f"was_{h}") for h in HEADS])
            same = None
            for c in own[:-1]:
                same = groups[c].eqNullSafe(up[f"_{c}"]) if same is None else same & groups[c].eqNullSafe(up[f"_{c}"])
            groups = groups.join(up, same).withColumns({f"up_{h}": F.col(f"was_{h}") for h in HEADS}).drop(*[f"_{c}" for c in own[:-1]], *[f"was_{h}" for h in HEADS])
        # between-group variance beyond what documents' variance explains, weighted by documents
        moments = []
        for h in HEADS:
            m = F.col(f"s_{h}") / F.col("n")
            moments += [F.sum(F.col("n") * F.pow(m - F.col(f"up_{h}"), 2)).alias(f"b_{h}"), F.sum(F.greatest(F.lit(0.0), F.col(f"q_{h}") / F.col("n") - m * m)).alias(f"w_{h}"), F.sum(F.col("n") * F.col(f"up_{h}") * (1 - F.col(f"up_{h}"))).alias(f"v_{h}")]
        got = groups.agg(F.sum("n").alias("n"), *moments).first()
        for h in HEADS:
            size = max(1, got["n"] or 0)
            between = ((got[f"b_{h}"] or 0.0) - (got[f"w_{h}"] or 0.0)) / size
            spread = (got[f"v_{h}"] or 0.0) / size
            strength = min(STRENGTH[1], max(STRENGTH[0], spread / between - 1 if between > 0 else STRENGTH[1]))
            groups = groups.withColumn(f"post_{h}", (F.col(f"s_{h}") + strength * F.col(f"up_{h}")) / (F.col("n") + strength))
        above = groups
    return written(above.select(*levels, *[(_logit(F.col(f"post_{h}")) - _logit(F.lit(overall[h]))).alias(f"shift_{h}") for h in HEADS]), "quality-shifts")


def sited(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs and the names of its levels: host and path (up to its last /) of a column url, which are added, else LEVELS."""
    if "url" not in docs.columns:
        return docs, LEVELS
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1)
    return docs.withColumns({"_host": host, "_path": path}), ("_host", "_path")


@small_batches
def judge(docs: DataFrame, labels: DataFrame, levels: tuple[str, ...] | None = None, reject: float = REJECT, rows: int = TRAINING_ROWS, text: bool = True) -> DataFrame:
    """docs with columns p_low, p_toxic (the text's evidence), site_low, site_toxic (log odds by the site), post_low, post_toxic and keep.

    keep is false where either posterior chance is beyond `reject`. Levels are those of sited() unless given. Null and empty
    texts are judged as texts without words. A null level value is a site of its own. Without labels, or with one class
    only, a head says the class's share. Other columns pass through, the text only if it is asked for; columns with those
    names are overwritten. Rows are judged one by one, repeated ids too. Texts are read once: their evidence is written down
    beside the columns that are asked for, summed by site, and met with the sites' shifts.
    """
    model = trained(docs, labels, rows)

    @F.pandas_udf("low double, toxic double")
    def evidence(texts: pd.Series) -> pd.DataFrame:
        claim("quality", dict)  # nothing of its own to clear
        return pd.DataFrame(1 / (1 + np.exp(-model.log_odds(texts))), columns=list(HEADS))

    made = [f"{k}_{h}" for k in ("p", "site", "post") for h in HEADS]
    docs = docs.drop(*made, "keep", "_e", "_host", "_path")
    if levels is None:
        docs, levels = sited(docs)
    docs = docs.drop(*[f"_at{i}" for i in range(len(levels))])
    seen = docs.withColumn("_e", evidence("text"))
    seen = written(seen if text else seen.drop("text"), "quality-evidence")
    shifts = site_shifts(seen.select(*levels, *[F.col(f"_e.{h}").alias(f"p_{h}") for h in HEADS]), levels)
    at = shifts.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(levels)], *[F.col(f"shift_{h}").alias(f"site_{h}") for h in HEADS])
    at = F.broadcast(at) if shifts.count() <= BROADCAST_SITES else at
    same = F.lit(True)
    for i, c in enumerate(levels):
        same = same & F.col(c).eqNullSafe(F.col(f"_at{i}"))
    out = seen.join(at, same).drop("_host", "_path", *[f"_at{i}" for i in range(len(levels))])
    out = out.withColumns({f"p_{h}": F.col(f"_e.{h}") for h in HEADS}).drop("_e")
    out = out.withColumns({f"post_{h}": 1 / (1 + F.exp(-(_logit(F.col(f"p_{h}")) + F.col(f"site_{h}")))) for h in HEADS})
    return out.withColumn("keep", (F.col("post_low") <= reject) & (F.col("post_toxic") <= reject))
