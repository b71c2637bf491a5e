"""Text quality by a sparse rule ensemble.

Statistics of whole texts are columns. Boosted trees on a bounded sample of labelled documents are taken apart into their
paths, each a conjunction of comparisons; a lasso logistic model keeps the few that matter and weighs them; and the
rules become one Spark column expression over the statistics, so scoring after them is JVM code.

Defined results: null and empty texts have all statistics 0 and are scored like any other text. Without labelled rows, or
with one class only, every document gets the smoothed share of label 1. Rows are kept one for one; columns other than
doc_id and text are ignored; a document with several label rows uses the largest label.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, sample_ids, sample_texts
from .trees import boost, lasso_logistic

STATS = ("n_words", "word_len", "long_words", "upper", "digits", "punct", "symbols", "ends_sign", "repeat_next", "distinct", "top_word", "line_words", "same_lines", "sentence_len", "deflated", "letters", "lone_signs")
#: Signs that words of prose end with.
_USUAL = frozenset(".,;:!?'\")]}»”’…-")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of one text: counts and shares of its words, characters and lines."""
    if not text:
        return (0.0,) * len(STATS)
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = np.bincount(a, minlength=256)
    size = len(a)
    upper, digits = c[65:91].sum(), c[48:58].sum()
    letters = upper + c[97:123].sum() + c[128:].sum()
    marks = c[[33, 34, 39, 40, 41, 44, 46, 58, 59, 63]].sum()
    symbols = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum() - marks
    lens = np.fromiter(map(len, words), np.int64, n)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    same = sum(map(str.__eq__, words[1:], words))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(not (w[-1].isalnum() or w[-1] in _USUAL) for w in words)
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    raw = a.tobytes()
    packed = sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, size, 65536))
    return (
        float(np.log1p(n)), float(lens.mean()), float((lens > 12).mean()), upper / max(letters, 1), digits / size, marks / size, symbols / size, ends / n, same / n, len(count) / n,
        max(count.values()) / n, n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), n / (1 + len(_SENTENCE.findall(text))), packed / size, letters / size, lone / n,
    )


_SCHEMA = ", ".join(f"s_{s} double" for s in STATS)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                x = np.array([statistics(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T)], names=["doc_id", *(f"s_{s}" for s in STATS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


@dataclass
class Rules:
    """Conjunctions of (statistic, is_below, threshold) with weights, and what to add."""

    intercept: float
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]]

    def expression(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for weight, parts in self.rules:
            holds = reduce(lambda x, y: x & y, (F.col(f"s_{s}") <= t if below else F.col(f"s_{s}") > t for s, below, t in parts))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.0015, trees: int = 30) -> Rules:
    if not len(y) or len(np.unique(y)) < 2:
        p = (float(y.sum()) + 1) / (len(y) + 2)
        return Rules(float(np.log(p / (1 - p))), [])
    _, grown = boost(x, y.astype(float), trees=trees, depth=3)
    paths = list(dict.fromkeys(p for t in grown for p in t.paths()))
    holds = np.ones((len(x), len(paths)), np.float32)
    for k, path in enumerate(paths):
        for f, below, t in path:
            holds[:, k] *= (x[:, f] <= t) if below else (x[:, f] > t)
    use = [k for k in range(len(paths)) if 0.002 <= holds[:, k].mean() <= 0.998]
    b, w = lasso_logistic(holds[:, use], y.astype(float), penalty)
    kept = [(float(v), tuple((STATS[f], below, float(t)) for f, below, t in paths[use[k]])) for k, v in enumerate(w) if abs(v) > 1e-4]
    return Rules(b, kept)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held: int, folds: int, per_class: int, class_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, y, text) of at most per_class labelled documents of each class, none of the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    return sample_texts(docs.select("doc_id", "text"), sample_ids(known, per_class, "y"), "y", ["doc_id"], class_bytes)


def prior_shift(labels: DataFrame, label: str, held: int, folds: int, y: np.ndarray) -> float:
    """What to add to log-odds learnt on a sample with other class shares than the labelled rows have."""
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = {int(r.y > 0): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0, m1, m0 = n.get(1, 0), n.get(0, 0), int((y > 0).sum()), int((y <= 0).sum())
    return float(np.log(n1 / n0 * m0 / m1)) if n1 and n0 and m1 and m0 else 0.0


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held: int = 2, folds: int = 4, per_class: int = 1000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learnt from at most per_class documents of each class."""
    rows = training_sample(docs, labels, label, held, folds, per_class).toPandas().sort_values("doc_id", kind="stable")
    y = rows["y"].to_numpy()
    rules = fit_rules(np.array([statistics(t) for t in rows.text]).reshape(len(y), len(STATS)), y)
    rules.intercept += prior_shift(labels, label, held, folds, y) if rules.rules else 0.0
    scored = with_statistics(docs).withColumn("score", rules.expression())
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
