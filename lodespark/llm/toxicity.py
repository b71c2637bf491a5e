"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks, trained on labelled sentences.

Kernel: two words are alike as far as they share subsequences of three characters; a subsequence that spans s
characters (at most SPAN) counts DECAY ** s, so gaps and inserted characters cost little; the normed value is raised to the power POWER, so
that a chance likeness counts nearly nothing. Words are cleaned first: lower case, inner digits and signs that stand for letters, other signs
dropped, runs of single letters joined; long words are cut into overlapping pieces, which are words of their own. The kernel
of two sentences is the sum over their pairs of distinct words.

Training: documents of a bounded labelled sample are cut into sentences. Landmarks are words much more frequent in toxic documents, and
some others, and words of clean sentences that a first machine finds worst. A sentence's features are the sum of its words' kernel values with the landmarks, whitened by the landmarks' own
kernel matrix. A squared-hinge machine is fitted on all sentences with their document's label; as one insult makes a document
toxic, it is then fitted again on the sentence of each toxic document that it finds worst, against all sentences of the others.

Scoring: a sentence's decision is the sum of its words', and a word's is a weighted sum of its kernel values with the landmarks, which is
remembered. A document's decisions (an empty sentence's where it has none) are pooled by their maximum and by a soft mean; the score is a
logistic function that rises with both, fitted on documents the machine did not see, for classes as frequent as in the sample, that is about equally frequent ones: toxic documents are rare, and missing one costs more.

Defined results: null and empty texts have one empty sentence. Without labelled rows, or with
one class, every document gets the smoothed share. Rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .quality import training_sample

SPAN, DECAY, POWER = 7, 0.8, 2
#: Longer words are cut into pieces of this length that overlap by half, and longer sentences into runs of so many words.
LONGEST, MOST_WORDS = 24, 32
MEMO = 300_000
#: Least chi-square of a landmark.
TELLING = 9.0
#: Characters that often stand for letters inside words (fixed values).
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
_JUNK = re.compile(r"[\W\d_]+")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]+){2,}[^\W\d_](?!\w)")
_PAIRS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def clean(token: str) -> str:
    word = _EDGES.sub("", token)
    if not word.isalpha():
        word = _JUNK.sub("", word.translate(LOOKALIKE))
    return word


def _joined(text: str) -> str:
    """Lower case, with letters that are spaced out (three or more) joined."""
    text = text.lower()
    return _SPACED.sub(lambda m: _JUNK.sub("", m.group()), text) if " " in text else text


def tokens(text: str) -> list[str]:
    """Lower-case tokens between white space; letters spaced out (three or more) are joined first."""
    return _joined(text).split()


def sentences(text: str | None) -> list[list[str]]:
    """The tokens of each sentence, of half-overlapping runs of a long one; one empty sentence where there are no tokens."""
    out = []
    for s in _SENTENCE.split(_joined(text or "")):
        ws = s.split()
        if len(ws) <= MOST_WORDS:
            out.append(ws)
        else:
            out += [ws[i : i + MOST_WORDS] for i in range(0, len(ws) - MOST_WORDS // 2, MOST_WORDS // 2)]
    return [ws for ws in out if ws] or [[]]


def pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@dataclass
class Alphabet:
    """Characters of the landmarks as numbers from 1; all others are 0 and match nothing."""

    codes: dict[int, int]

    @property
    def size(self) -> int:
        return max(self.codes.values(), default=0) + 1

    def flatten(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words end to end, each word's length, its first place."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(max(int(raw.max(initial=0)) + 1, max(self.codes, default=0) + 1), np.int64)
        for c, k in self.codes.items():
            table[c] = k
        return table[raw], n, np.cumsum(n) - n


def triples(codes: np.ndarray, n: np.ndarray, size: int):
    """(word, triple, weight) arrays for each pair of gaps."""
    word = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(n)[word]
    at = np.arange(len(codes))
    for i, j in _PAIRS:
        a = np.flatnonzero(at + j < end)
        if len(a):
            x, y, z = codes[a], codes[a + i], codes[a + j]
            ok = (x > 0) & (y > 0) & (z > 0)
            a = a[ok]
            yield word[a], (x[ok] * size + y[ok]) * size + z[ok], DECAY ** (j + 1)


def counted(codes: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, value) in order: the normed weight of each triple in each word. A triple with a character that the alphabet lacks counts in the norm, as if it were alone."""
    parts = [(word * size**3 + triple, np.full(len(word), weight)) for word, triple, weight in triples(codes, n, size)]
    key, weight = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(weight, at) if len(at) else weight
    word, triple = np.divmod(key[at], size**3)
    norm = sum(np.maximum(n - j, 0) * DECAY ** (2 * (j + 1)) for _, j in _PAIRS) - np.bincount(key // size**3, weight**2, len(n)) + np.bincount(word, total**2, len(n))
    return word, triple, total / np.sqrt(norm + 1e-9)[word]


@dataclass
class Kernel:
    """The landmarks' side of the kernel: their triples and, for each triple, its normed count in each landmark."""

    alphabet: Alphabet
    used: np.ndarray  # sorted triples
    first: np.ndarray  # of each, its first entry below
    landmark: np.ndarray
    count: np.ndarray
    size: int  # landmarks

    def places(self):
        """Where triples stand in `used`, -1 for others: by a table where the alphabet is small."""
        size = self.alphabet.size**3
        if size > 1 << 22:
            return lambda triple: find(self.used, triple)
        table = np.full(size, -1, np.int32)
        table[self.used] = np.arange(len(self.used))
        return table.__getitem__

    def values(self, words: list[str]) -> np.ndarray:
        """words x landmarks, for words of at most LONGEST characters."""
        out = np.zeros((len(words), self.size))
        many = np.diff(self.first)
        place = self.places()
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            codes, n, _ = self.alphabet.flatten(part)
            word, triple, value = counted(codes, n, self.alphabet.size)
            k = place(triple)
            there = np.flatnonzero(k >= 0)
            word, k, value = word[there], k[there], value[there]
            m = many[k]
            entry = np.repeat(self.first[k] - np.cumsum(m) + m, m) + np.arange(m.sum())
            out[a : a + len(part)] = np.bincount(np.repeat(word, m) * self.size + self.landmark[entry], weights=self.count[entry] * np.repeat(value, m), minlength=len(part) * self.size).reshape(len(part), self.size)
        return out**POWER


@dataclass
class Machine:
    kernel: Kernel
    landmarks: list[str]
    alpha: np.ndarray  # the landmarks' weights
    bias: float
    scale: np.ndarray  # score: a logistic function that rises with both pooled decisions

    def word_weights(self, words: list[str]) -> np.ndarray:
        """The sum over each word's pieces of their kernel values with the landmarks, weighted."""
        cut = [pieces(w) for w in words]
        own = np.repeat(np.arange(len(words)), [len(c) for c in cut])
        return np.bincount(own, weights=self.kernel.values([p for c in cut for p in c]) @ self.alpha, minlength=len(words))

    def scorer(self):
        """decisions(texts): of each, its sentences' decisions, pooled."""
        memo: dict[str, float] = {}

        def decisions(texts: list[str | None]) -> np.ndarray:
            if len(memo) > MEMO:
                memo.clear()
            split = [sentences(t) for t in texts]
            new = list(dict.fromkeys(w for d in split for s in d for w in s if w not in memo))
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                memo.update(zip(part, self.word_weights([clean(w) for w in part]).tolist(), strict=True))
            lines = np.array([sum(map(memo.__getitem__, set(s))) for d in split for s in d]) + self.bias
            return pooled(lines, np.cumsum([0, *map(len, split)])[:-1]) if len(split) else np.zeros((0, 2))

        return decisions

    def scores(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(decisions @ self.scale[:-1] + self.scale[-1], -30, 30)))


def pooled(lines: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document's sentence decisions (at most 8 counts): the greatest, and the logarithm of the mean of their exponentials, which tells one bad sentence among few from one among many."""
    lines = np.minimum(lines, 8.0)
    n = np.diff(np.append(first, len(lines)))
    return np.stack([np.maximum.reduceat(lines, first), np.log(np.add.reduceat(np.exp(lines), first) / n)], 1)


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x stands in sorted keys, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def _landmarks(vocab: list[str], lines: list[np.ndarray], toxic: np.ndarray, many: int, others: int) -> list[str]:
    """Words by a signed chi-square of the distinct sentences that hold them (copies count once), then some of the most frequent rest."""
    own = dict.fromkeys((x.tobytes(), bool(t)) for x, t in zip(lines, toxic, strict=True))
    c = np.zeros((len(vocab), 2))
    n = np.zeros(2)
    for raw, k in own:
        c[np.unique(np.frombuffer(raw, np.int32)), int(k)] += 1
        n[int(k)] += 1
    right = np.array([3 <= len(w) <= LONGEST for w in vocab], bool)
    expect = c.sum(1) * n[1] / max(n.sum(), 1)
    score = np.where(right & (c[:, 1] > expect), (c[:, 1] - expect) ** 2 / np.maximum(expect, 1e-9), 0)
    word = np.array(vocab, object)
    first = [i for i in np.lexsort((word, -score))[:many] if score[i] >= TELLING]
    rest = np.lexsort((word, -np.where(right, c.sum(1), -1)))[: 20 * others : 20]
    return [vocab[i] for i in dict.fromkeys([*first, *rest]) if right[i]]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None, c: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights and, last, bias: squared hinge loss with a ridge, by accelerated gradient from `start`; y is -1 or 1, rows of weight 0 have no say."""
    y, weight = y.astype(x.dtype), (weight / weight.sum()).astype(x.dtype)
    apply = lambda w: x @ w[:-1] + w[-1]
    back = lambda v: np.append(x.T @ v, v.sum())
    top = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(15):
        v = back(weight * apply(top))
        size = np.linalg.norm(v)
        top = v / (size + 1e-12)
    ridge = 1e-4 / c
    step = x.dtype.type(1 / (2 * size + ridge))
    w = np.zeros(x.shape[1] + 1, x.dtype) if start is None else start.astype(x.dtype)
    z, t = w, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * apply(z))
        new = z - step * (-2 * back(weight * y * slack) + x.dtype.type(ridge) * z)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + x.dtype.type((t - 1) / nt) * (new - w), new, nt
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, none of them negative, and offset of a logistic function, classes weighted alike, by projected Newton steps with a little ridge."""
    y = y.astype(float)
    mid, wide = x.mean(0), np.maximum(x.std(0), 1e-3)
    u = np.hstack([(x - mid) / wide, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    best = None
    for free in ((0, 1, 2), (0, 2), (1, 2)):  # the best of those without a negative slope
        v, w, ridge = u[:, free], np.zeros(len(free)), np.diag([1e-3] * (len(free) - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(v @ w, -30, 30)))
            w -= np.clip(np.linalg.solve((v * (weight * p * (1 - p))[:, None]).T @ v + ridge, v.T @ (weight * (p - y)) + ridge @ w), -2, 2)
        w[:-1] = np.maximum(w[:-1], 1e-6) if len(free) == 2 else w[:-1]
        p = np.clip(1 / (1 + np.exp(-np.clip(v @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if (w[:-1] > 0).all() and (best is None or loss < best[0]):
            full = np.zeros(3)
            full[list(free)] = w
            best = (loss, full)
    slopes = best[1][:2] / wide
    return np.append(slopes, best[1][2] - slopes @ mid)


def fit(texts: list[str], y: np.ndarray, landmarks: int = 128, others: int = 16, hard: int = 160, rounds: int = 4) -> Machine | float:
    """A machine, or the smoothed share where there is only one class."""
    if len(set(y.tolist())) < 2:
        return (float(y.sum()) + 1) / (len(y) + 2)
    number: dict[str, int] = {}
    lines: list[np.ndarray] = []
    size = []
    for t in texts:
        own = [np.array([number.setdefault(p, len(number)) for w in dict.fromkeys(s) for p in pieces(clean(w))], np.int32) for s in sentences(t)]
        lines += own
        size.append(len(own))
    vocab = list(number)
    doc = np.repeat(np.arange(len(texts)), size)
    toxic = y[doc] > 0
    marks = _landmarks(vocab, lines, toxic, landmarks, others)
    # a fifth of the documents is kept for the calibration, if both classes are in both parts
    held = np.arange(len(y)) % 5 == 4
    if any(len(set(y[part].tolist())) < 2 for part in (held, ~held)):
        held = np.zeros(len(y), bool)
    use = ~held[doc]
    spoken = np.zeros(len(vocab), bool)  # in sentences of documents that are not toxic
    for x, t, u in zip(lines, toxic, use, strict=True):
        if u and not t:
            spoken[x] = True
    for again in range(2):
        kernel, white = _nystroem(marks)
        rows = np.zeros((len(vocab), white.shape[1]), np.float32)
        for a in range(0, len(vocab), 10_000):
            rows[a : a + 10_000] = kernel.values(vocab[a : a + 10_000]) @ white
        z = np.zeros((len(lines), white.shape[1]), np.float32)
        for i, x in enumerate(lines):
            z[i] = rows[x].sum(0)
        w, bias = _multiple(z, doc, toxic, use, rounds)
        if not again:  # words of clean sentences that look worst become landmarks too
            g = np.where(spoken, rows @ w, 0)
            worst = [vocab[i] for i in np.lexsort((np.array(vocab, object), -g))[:hard] if g[i] > 0 and 3 <= len(vocab[i]) <= LONGEST]
            marks = list(dict.fromkeys(marks + worst))
        del z
    machine = Machine(kernel, marks, white @ w, bias, np.zeros(3))
    part = held if held.any() else ~held
    machine.scale = _logistic(machine.scorer()([t for t, h in zip(texts, part, strict=True) if h]), y[part])
    return machine


def _nystroem(marks: list[str]) -> tuple[Kernel, np.ndarray]:
    """The landmarks' side of the kernel, and the matrix that kernel values are multiplied with to give features."""
    alphabet = Alphabet({ord(ch): k + 1 for k, ch in enumerate(sorted({ch for w in marks for ch in w}))})
    codes, n, _ = alphabet.flatten(marks)
    word, triple, value = counted(codes, n, alphabet.size)
    used, place = np.unique(triple, return_inverse=True)
    counts = np.bincount(place * len(marks) + word, weights=value, minlength=len(used) * len(marks)).reshape(len(used), len(marks))
    lam, vec = np.linalg.eigh((counts.T @ counts) ** POWER)
    keep = lam > 1e-6 * max(lam.max(initial=0), 1e-12)
    k, mark = np.nonzero(counts)
    return Kernel(alphabet, used, np.searchsorted(k, np.arange(len(used) + 1)), mark, counts[k, mark], len(marks)), vec[:, keep] / np.sqrt(lam[keep])


def _multiple(z: np.ndarray, doc: np.ndarray, toxic: np.ndarray, use: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias: fitted on all sentences, then `rounds` times on the worst one of each toxic document against all of the others."""
    w = None
    for _ in range(1 + rounds):
        mine = use.copy()
        if w is not None:
            f = z @ w[:-1]
            order = np.lexsort((-f, doc))
            worst = np.zeros(len(doc), bool)
            worst[order[np.diff(doc[order], prepend=-1) > 0]] = True
            mine &= ~toxic | worst
        weight = np.where(mine, np.where(toxic, 0.5 / max((mine & toxic).sum(), 1), 0.5 / max((mine & ~toxic).sum(), 1)), 0)
        w = _svm(z, np.where(toxic, 1.0, -1.0), weight, w)
    return w[:-1].astype(float), float(w[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: int = 1, folds: int = 3, per_class: int = 700, class_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learnt from at most per_class documents and class_bytes bytes of each class (one document at least)."""
    rows = training_sample(docs, labels, label, held, folds, per_class, class_bytes).toPandas().sort_values(["doc_id", "text"], kind="stable")
    own = docs.sparkSession.sparkContext.broadcast(fit([t or "" for t in rows.text], rows["y"].to_numpy(int)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = own.value
        decisions = None if isinstance(machine, float) else machine.scorer()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                p = np.full(part.num_rows, machine) if isinstance(machine, float) else machine.scores(decisions(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
