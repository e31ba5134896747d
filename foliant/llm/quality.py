"""A quality classifier made of rules, compiled to Spark column expressions.

Shallow trees are grown on bounded samples; every path from a root is a conjunction of
thresholds over text statistics; lasso logistic regression keeps a few of these rules. The
score of a document is then one column expression over its statistics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, in_parts, text_hash

#: Labelled rows that the model is fitted on at most: those with the least hashes of their ids and statistics.
SAMPLE_ROWS = 20_000

_CLASS = np.zeros(256, np.uint8)  # 0 other symbols
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
_CLASS[[ord(c) for c in " \t\r\x0b\x0c"]] = 4
_CLASS[ord("\n")] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 6
_CLASS[128:] = 7
_CLASS[ord("!")] = 8
_CLASS[ord("|")] = 9

STATISTICS = (
    "log_chars", "lower", "upper", "digit", "space", "mark", "wide", "shout", "bar", "symbol", "log_words", "word_length", "distinct_words",
    "log_lines", "line_words", "repeated_lines", "ended_lines", "capital_words",
)


def statistics(text: str) -> list[float]:
    """Shares and means that describe a text; all zero if it is empty."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode(errors="replace"), np.uint8)
    seen = np.bincount(_CLASS[data], minlength=10) / len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    return [
        float(np.log1p(len(text))), *map(float, seen[[1, 2, 3, 4, 6, 7, 8, 9, 0]]), float(np.log1p(len(words))), sum(map(len, words)) / n, len(set(words)) / n,
        float(np.log1p(len(lines))), n / m, 1 - len(set(lines)) / m, sum(x[-1] in ".!?:\"" for x in lines) / m, sum(w[:1].isupper() for w in words) / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``id_col`` and the statistics of every whole text; null counts as empty, ids may be null. ``hashed``: also __hash, the text's."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            out = pd.DataFrame([statistics(t) for t in batch["text"].tolist()], columns=list(STATISTICS))
            out.insert(0, id_col, batch["id"].to_numpy())
            if hashed:
                out["__hash"] = batch["hash"].to_numpy()
            yield out

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([text_hash(text_col).alias("hash")] if hashed else []))
    schema = f"`{id_col}` string, " + ", ".join(f"{s} double" for s in STATISTICS) + (", __hash string" if hashed else "")
    return rows.mapInPandas(each, schema).withColumn(id_col, F.col(id_col).cast(kind))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at or below the threshold?, threshold), all must hold


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, rule: Rule = ()) -> Iterator[Rule]:
    """Paths of a tree that splits by Gini gain over a random half of the statistics."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (1e-6, -1, 0.0)
    base = y.mean() * (1 - y.mean())
    for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
        order = np.argsort(x[:, f], kind="stable")
        v, up = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= 5) & (at <= len(y) - 5)]
        if not len(at):
            continue
        a, n = up[at - 1], len(y)
        p, q = a / at, (up[-1] - a) / (n - at)
        gain = base - (at * p * (1 - p) + (n - at) * q * (1 - q)) / n
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
    _, f, t = best
    if f < 0:
        return
    for low in (True, False):
        inside = (x[:, f] <= t) == low
        path = (*rule, (f, low, t))
        yield path
        yield from _grow(x[inside], y[inside], rng, depth - 1, path)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] <= t) == low for f, low, t in rule])


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * _holds(x, r)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over the columns of ``STATISTICS``."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            tests = [(F.col(STATISTICS[f]) <= F.lit(t)) if low else (F.col(STATISTICS[f]) > F.lit(t)) for f, low, t in rule]
            z = z + F.when(reduce(lambda a, b: a & b, tests), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def to_json(self) -> str:
        return json.dumps({"rules": self.rules, "weights": self.weights, "bias": self.bias})


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rows: int = 2000, penalty: float = 0.002, steps: int = 400, seed: int = 7) -> RuleModel:
    """Rules of ``trees`` trees, each on ``rows`` sampled rows with both labels evenly drawn, weighted by lasso logistic regression.

    Without rows, or with one label only, the model is a constant.
    """
    n = len(y)
    if n == 0 or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (n + 1)
        return RuleModel([], [], float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    rules: dict[Rule, np.ndarray] = {}
    for _ in range(trees):
        at = np.concatenate([rng.choice(s, min(rows // 2, 4 * len(s))) for s in sides])
        for rule in _grow(x[at], y[at].astype(float), rng, depth):
            rules.setdefault(rule, _holds(x, rule))
    kept: dict[bytes, Rule] = {}
    for rule, holds in rules.items():  # rules that mark the same rows count once, the shortest
        if 0 < holds.sum() < n and ((key := np.packbits(holds).tobytes()) not in kept or len(rule) < len(kept[key])):
            kept[key] = rule
    names = list(kept.values())
    a = np.stack([rules[r] for r in names], axis=1).astype(np.float64) if names else np.zeros((n, 0))
    mean = a.mean(axis=0)
    a -= mean
    w, b = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    step = 4 / (max(1.0, float(np.linalg.norm(a, 2)) ** 2 / n) + 1)
    u, v, t = w, b, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(a @ u + v)))
        g = a.T @ (p - y) / n
        new = u - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        c = v - step * float((p - y).mean())
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, v = new + (t - 1) / s * (new - w), c + (t - 1) / s * (c - b)
        w, b, t = new, c, s
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([names[i] for i in some], [float(w[i]) for i in some], float(b - (w[some] * mean[some]).sum()))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Scores every whole text by rules learned from the labels that are not held out.

    Columns: ``id_col``, held_out, score, predicted (1 if the score is at least ``threshold``).

    Only text statistics enter a score. The fit sees at most ``sample_rows`` labelled rows
    (the least hashes of id and statistics, whatever the table's size; the driver gets about
    twice as many at most). Null text counts as empty and is
    scored like any; a null id is scored, is not held out unless the empty text's crc says so,
    and meets no label. Repeated labels of an id are averaged and rounded half up, null labels
    ignored; repeated documents are scored each. Without labels the score is a constant.
    """
    scored = _scored(docs, labels, id_col, text_col, label_col, sample_rows)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, hashed: bool = False) -> DataFrame:
    stats = cut(with_statistics(docs, id_col, text_col, hashed))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("labelled")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    # the least hashes lie below a threshold known from the count alone, so no task sends more than its share
    order = F.xxhash64("labelled", *STATISTICS)
    joined = stats.join(known, stats[id_col] == known["labelled"])
    if (n := known.count()) > 2 * sample_rows:
        joined = joined.where(order < F.lit(int((4 * sample_rows / n - 1) * (1 << 63))).cast("long"))  # twice the rows wanted
    rows = joined.orderBy(order, "labelled", *STATISTICS).limit(sample_rows).select("y", *STATISTICS).toPandas()
    model = fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(int))
    return stats.withColumn("score", model.column())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    Every row is judged by its own text, whether its id is null or shared or neither.
    """
    none = F.lit(-(1 << 63))
    good = _scored(docs, labels, id_col, text_col, hashed=True).where(F.col("score") >= F.lit(threshold)).select(F.coalesce(F.col(id_col), none).alias("__id"), "__hash")
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), none)).withColumn("__hash", text_hash(text_col))
    return keyed.join(good, ["__id", "__hash"], "left_semi").select(*docs.columns)
