"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of letter runs ("words") between a start and an end mark, orders 1 to
`order`. A model is, for each order, a sorted array of n-gram hashes with the discounted probabilities and a sorted
array of context hashes with the back-off weights; a look-up is a binary search. A text's cross-entropy under a model is
the mean over all characters of all its words, so every word is scored once and counted as often as it occurs.

Models are fitted on a bounded sample of labelled documents (`per_language` of each language); four fifths fit the
counts, one fifth calibrates the rejection limit and the score.

Defined results: null text, empty text or a text without a letter gives `und`, score 0.0, rejected. With no labelled
rows every document gives `und`. Rows are kept one for one, repeated ids included; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, dotted, extended, fold, mix64, release, sample_ids, sample_texts, undotted

LETTERS = re.compile(r"[^\W\d_]+")
BOS, EOS = 0x110000, 0x110001
ORDER = 5
#: Words kept with their log-probabilities by each Python worker.
MEMO = 200_000


def _flatten(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their marks, each one's place in its word, each one's word."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    text = "".join(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    ends = np.cumsum(n + 2)
    starts = ends - n - 2
    out = np.empty(int(ends[-1]) if len(words) else 0, U64)
    inner = np.ones(len(out), bool)
    inner[starts] = False
    inner[ends - 1] = False
    out[starts], out[ends - 1], out[inner] = BOS, EOS, codes
    word = np.repeat(np.arange(len(words)), n + 2)
    return out, np.arange(len(out)) - starts[word], word


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n codes that end at each place, for n = 0 .. order; valid where place >= n - 1."""
    out = [np.zeros(len(codes), U64)]
    for _ in range(order):
        before = np.roll(out[-1], 1)
        out.append(mix64(before * U64(0x9E3779B97F4A7C15) + codes + U64(1)))
    return out


@dataclass
class CharModel:
    """Sorted hash arrays of one language: per order the n-grams with probabilities, the contexts with back-off weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    probs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = 1e-5

    @staticmethod
    def fit(words: list[str], counts: np.ndarray, order: int = ORDER) -> CharModel:
        codes, place, word = _flatten(words)
        g = _grams(codes, order)
        model = CharModel(floor=1.0 / max(64, len(np.unique(codes)) * 2))
        for n in range(1, order + 1):
            at = np.flatnonzero((place >= n - 1) & (place >= 1))  # the start mark is never predicted
            key, where, inv = np.unique(g[n][at], return_index=True, return_inverse=True)
            c = np.bincount(inv, weights=counts[word[at]], minlength=len(key))
            if n < order:  # distinct left neighbours instead of counts, but for n-grams that begin a word
                up = np.flatnonzero((place >= n) & (place >= 1))
                _, first = np.unique(g[n + 1][up], return_index=True)
                left, many = np.unique(g[n][up[first]], return_counts=True)
                cont = np.zeros(len(key))
                cont[np.searchsorted(key, left)] = many
                c = np.where(place[at[where]] == n - 1, c, np.maximum(cont, 1))
            n1, n2 = int((c == 1).sum()), int((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
            ctx_of = np.roll(g[n - 1], 1)[at[where]] if n > 1 else np.zeros(len(key), U64)
            ctx, ci = np.unique(ctx_of, return_inverse=True)
            total = np.bincount(ci, weights=c, minlength=len(ctx))
            kinds = np.bincount(ci, minlength=len(ctx))
            model.grams.append(key)
            model.probs.append(((c - d).clip(0) / total[ci]).astype(np.float32))
            model.contexts.append(ctx)
            model.backoff.append((d * kinds / total).astype(np.float32))
        return model

    def log_probs(self, keys: list[np.ndarray], at: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """keys: per order the sorted distinct n-gram hashes, at: where each place's is; sorted needles are found fastest."""
        p = np.full(len(place), self.floor)
        for n in range(1, len(self.grams) + 1):
            w = _find(self.contexts[n - 1], keys[n - 1], self.backoff[n - 1], 1)[at[n - 1]]
            w = np.roll(w, 1) if n > 1 else w
            q = _find(self.grams[n - 1], keys[n], self.probs[n - 1], 0)[at[n]]
            p = np.where(place >= n - 1, q + w * p, p)
        return np.log(p)


def _find(keys: np.ndarray, needles: np.ndarray, values: np.ndarray, none: float) -> np.ndarray:
    at = np.searchsorted(keys, needles)
    at[at == len(keys)] = 0
    return np.where(keys[at] == needles, values[at], none)


@dataclass
class LanguageModels:
    names: list[str]
    models: list[CharModel]
    order: int = ORDER
    #: Per language: mean and spread of documents' cross-entropies in the calibration part.
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def words(self, new: list[str]) -> np.ndarray:
        """For each word, the sum of log-probabilities per language, then its number of predicted characters."""
        out = np.zeros((len(new), len(self.names) + 1))
        if new:
            codes, place, word = _flatten(new)
            keys, at = zip(*(np.unique(g, return_inverse=True) for g in _grams(codes, self.order)), strict=True)
            use = place >= 1
            for k, m in enumerate(self.models):
                out[:, k] = np.bincount(word[use], weights=m.log_probs(keys, at, place)[use], minlength=len(new))
            out[:, -1] = np.bincount(word[use], minlength=len(new))
        return out

    def scorer(self):
        """A function from a list of texts to (entropies per language, characters); known words are looked up."""
        memo: dict[str, int] = {}
        rows = np.zeros((0, len(self.names) + 1))

        def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal rows
            if len(memo) > MEMO:
                memo.clear()
                rows = rows[:0]
            split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
            new = list(dict.fromkeys(w for ws in split for w in ws if w not in memo))
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                memo.update(zip(part, range(len(memo), len(memo) + len(part)), strict=True))
                rows = np.vstack([rows, self.words(part)])
            total = np.zeros((len(texts), len(self.names) + 1))
            for i, ws in enumerate(split):
                if ws:
                    total[i] = rows[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(0)
            n = total[:, -1]
            return -total[:, :-1] / np.maximum(n, 1)[:, None], n

        return score

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score, rejected). The limit is wider for short texts, whose means vary more."""
        best = entropy.argmin(1)
        h = entropy[np.arange(len(best)), best]
        gap = (entropy - h[:, None]) * np.minimum(np.maximum(n, 1), 200)[:, None]
        score = 1.0 / np.exp(-np.minimum(gap, 50)).sum(1)
        limit = self.mean[best] + 6 * self.spread[best] + 4 / np.sqrt(np.maximum(n, 1))
        none = n == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), none | (h > limit)


def fit(docs: DataFrame, per_language: int = 1000, order: int = ORDER) -> LanguageModels:
    """Fits on at most `per_language` documents (doc_id, text, lang) of each language, whatever the size of `docs`."""
    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    chosen = sample_texts(rows.where(F.col("text").isNotNull()), sample_ids(rows, per_language, "lang"), "lang", ["doc_id", "lang"])
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0
    sample = chosen.select("lang", "text", part.alias("held")).toPandas()
    sample = sample.sort_values(["lang", "text"], kind="stable")
    names = sorted(sample.lang.unique())
    models = []
    for name in names:
        own = sample[sample.lang == name]
        count: dict[str, int] = {}
        for t in own.text[~own.held] if (~own.held).any() else own.text:
            for w in LETTERS.findall(t.lower()):
                count[w] = count.get(w, 0) + 1
        ws = sorted(count)
        models.append(CharModel.fit(ws, np.array([count[w] for w in ws], float), order) if ws else CharModel())
    out = LanguageModels(names, models, order, np.zeros(len(names)), np.ones(len(names)))
    for k, name in enumerate(names):
        own = sample[(sample.lang == name) & sample.held]
        h, n = out.scorer()(list(own.text))
        h = h[n >= 50, k]
        if len(h) >= 5:
            mid = np.median(h)
            out.mean[k], out.spread[k] = mid, max(0.02, 1.4826 * np.median(np.abs(h - mid)), (np.quantile(h, 0.99) - mid) / 3)
        else:
            out.mean[k], out.spread[k] = 3.0, 1.0
    return out


def identify(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """All columns of `docs` with lang_pred, lang_score, lang_rejected after them (over columns of those names)."""
    own = docs.sparkSession.sparkContext.broadcast(models)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    docs = undotted(docs.select(*(F.col(f"`{c}`") for c in kept)))

    def run(batches):
        m = own.value
        score = m.scorer()
        names = np.array([*m.names, "und"], object)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                if m.names:
                    k, s, no = m.decide(*score(part.column(text).to_pylist()))
                else:
                    k, s, no = np.full(part.num_rows, -1), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[k], pa.string()), pa.array(s), pa.array(no)], names=[*part.schema.names, "lang_pred", "lang_score", "lang_rejected"])
        del score
        release()

    return dotted(docs.mapInArrow(run, extended(docs, "lang_pred string, lang_score double, lang_rejected boolean")))


def language_id(docs: DataFrame, held_out_fold: int = 1, folds: int = 3, per_language: int = 1000) -> DataFrame:
    """Learns on the folds of `docs` that are not held out and predicts for all rows."""
    models = fit(docs.where(fold(F.col("doc_id"), folds) != held_out_fold), per_language)
    own = docs.select("doc_id", "text")
    return identify(own, models).withColumn("held_out", fold(F.col("doc_id"), folds) == held_out_fold)
