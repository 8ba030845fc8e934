"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

Two words are alike by the subsequences of three and four characters that they share, gaps allowed and weighed
down, so that inserted or missing characters cost likeness and do not destroy it. A sentence is as toxic as its most
toxic word, a document as its most toxic sentence. Sentences are learned from: those of clean documents are
negative; of a toxic document's sentences at least one is positive, and which ones is found in rounds of training,
among the words that stand in toxic documents more often than chance explains. A toxic document without any such word
teaches nothing.
After each round all words of all sampled texts are scored, and those of clean documents that score highest join
the negative examples; no word of a sampled text is left out of that.

Landmarks stand for the kernel (Nyström): a word's features are its likenesses to them, whitened. The machine being
linear in these, it is folded into one weight per subsequence of the landmarks, and words are scored by that, many at
a time. Scores of words are remembered up to a bound.

Defined results: a null or empty text, or one without letters, has the score of a document without any toxic word;
texts of any length are scored whole; repeated rows get equal scores; a score on the threshold is predicted toxic;
without labels of both kinds (or an empty table) every score is 0; other columns are kept and not looked at.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import labelled
from kinweave.llm.common import given_back, released

DECAY = 0.6
#: Subsequence length and the longest stretch of a word that it may span.
SPANS = ((3, 4), (4, 5))
LANDMARKS = 320
ROUNDS = 6
#: Words of clean documents that join the negative examples in a round, those of the highest scores first.
MINED = 1500
#: Log-likelihood ratio from which a word is taken to be told by the labels (a chance of about 1 in 3,000).
EVIDENCE = 13.0
#: Words that are scored together, and documents whose words are looked up together.
CHUNK, DOCUMENTS = 20_000, 128
#: Words whose subsequences are laid out together (some 60 a word), and those of them that meet all landmarks at once. Both bound what training holds on the driver; no result depends on them.
LAID, MET = 2_000, 50
_SHAPES = [(c, DECAY ** (c[-1] + 1)) for length, span in SPANS for c in [(0, *x) for x in combinations(range(1, span), length - 1)]]
_REACH = max(shape[-1] for shape, _ in _SHAPES)
_SPACED = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")
_INNER = re.compile(r"[\W_]+")


def tokens(text: str) -> set[str]:
    """Distinct words of a text, lower-cased; letters written one by one are also put together."""
    low = text.lower()
    found = set(low.split())
    for m in _SPACED.finditer(low):
        found.add(m[0])
    return found


def bare(token: str) -> str:
    """A token's letters and digits alone."""
    return token if token.isalnum() else _INNER.sub("", token)


def _norm(n: int) -> float:
    """Self-likeness of n characters whose subsequences all differ, by which likenesses are normalised."""
    return math.sqrt(sum(max(0, n - shape[-1]) * weight * weight for shape, weight in _SHAPES)) or 1.0


_NORMS = [_norm(n) for n in range(64)]


def _scales(words: list[str]) -> np.ndarray:
    return np.array([1 / (_NORMS[len(w) + 1] if len(w) < 63 else _norm(len(w) + 1)) for w in words])


class Letters:
    """Numbers for subsequences of words over an alphabet; a mark in front of a word tells its beginning. Characters outside the alphabet match nothing."""

    def __init__(self, letters: str):
        self.letters, self.base = letters, len(letters) + 2
        self.digit = np.zeros(0x110000, np.int32)
        self.digit[ord("^")] = 1
        self.digit[[ord(c) for c in letters]] = np.arange(2, self.base)

    def _laid(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(digits of all words, each with its mark in front and zeros behind, start of each)."""
        text = "".join([f"^{w}" + "\0" * _REACH for w in words])
        sizes = np.array([len(w) + 1 + _REACH for w in words], np.int64)
        return self.digit[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64), np.cumsum(sizes) - sizes

    def shapes(self, words: list[str]) -> tuple[np.ndarray, list[tuple[float, np.ndarray]]]:
        """(start of each word, for each shape its weight and the number of the subsequence that begins at each place). A number with a zero digit is none."""
        at, starts = self._laid(words)
        out = []
        for shape, weight in _SHAPES:
            n = len(at) - shape[-1]
            code = at[:n].copy()
            for k in shape[1:]:
                code *= self.base
                code += at[k : k + n]
            # Subsequences of different lengths have numbers of their own.
            out.append((weight, code if len(shape) == SPANS[0][0] else code + self.base ** len(shape)))
        return starts, out

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, number, normalised weight) of all subsequences."""
        at, starts = self._laid(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(at))))
        scale, found = _scales(words), []
        for (shape, _), (weight, code) in zip(_SHAPES, self.shapes(words)[1], strict=True):
            good = np.ones(len(code), bool)
            for k in shape:
                good &= at[k : k + len(code)] > 0
            i = np.flatnonzero(good)
            found.append((owner[i], code[i], weight * scale[owner[i]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chunks(words: list[str], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    for i in range(0, len(words), most):
        yield i, words[i : i + most]


def _place(codes: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each number among ordered ones, whether it is one of them)."""
    at = np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)
    return at, ordered[at] == codes


class Kernel:
    """Likenesses of words to landmarks."""

    def __init__(self, landmarks: list[str], letters: Letters | None = None):
        self.landmarks, self.letters = landmarks, letters or Letters("".join(sorted({c for w in landmarks for c in w} - {"^"})))
        word, code, weight = self.letters.parts(landmarks)
        self.codes, at = np.unique(code, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(landmarks)), np.float32)
        np.add.at(self.matrix, (at, word), weight)
        raw = self.likeness(landmarks)
        values, vectors = np.linalg.eigh((raw + raw.T) / 2)
        good = values > 1e-4 * values.max()
        self.whiten = vectors[:, good] / np.sqrt(values[good])

    def likeness(self, words: list[str]) -> np.ndarray:
        """A row of likenesses for each word."""
        out = np.zeros((len(words), len(self.landmarks)))
        for i, some in _chunks(words, MET):
            word, code, weight = self.letters.parts(some)
            at, known = _place(code, self.codes)
            np.add.at(out, word[known] + i, weight[known, None] * self.matrix[at[known]])
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return (self.likeness(words) @ self.whiten).astype(np.float32)

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """One weight per subsequence (in the order of ``codes``), for a linear machine over the features."""
        return self.matrix @ (self.whiten @ weights)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton's method in the primal; y is 1 or -1, cost a weight for each row."""
    rows = np.concatenate((x, np.ones((len(x), 1))), 1)
    w, ridge = np.zeros(rows.shape[1]), np.eye(rows.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        a = rows[active]
        weighed = (a * cost[active][:, None]).T
        w = np.linalg.solve(ridge + weighed @ a, weighed @ y[active])
        now = y * (rows @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


class Scores(dict):
    """Scores of tokens by the folded machine, remembered up to a bound."""

    BOUND = 300_000
    _BITS = 20

    def __init__(self, model: dict):
        super().__init__()
        self.letters, self.codes, self.weights, self.bias = Letters(model["letters"]), model["codes"], model["weights"], model["bias"]
        #: Most subsequences of a text aren't among the landmarks'; a bit for the hash of each that is keeps the others from being searched for.
        self.seen = np.zeros(1 << self._BITS, bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)).view(np.int64)

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for first, some in _chunks(words):
            starts, shapes = self.letters.shapes(some)
            total = np.zeros(len(shapes[0][1]) + _REACH)
            for weight, code in shapes:
                i = np.flatnonzero(self.seen[self._slot(code)])
                at, known = _place(code[i], self.codes)
                total[i[known]] += weight * self.weights[at[known]]
            out[first : first + len(some)] += np.add.reduceat(total, starts) * _scales(some)
        return out

    def documents(self, texts) -> list[float]:
        """Scores of documents, some at a time: words that are not remembered are scored together."""
        out = []
        texts = list(texts)
        for i in range(0, len(texts), DOCUMENTS):
            sets = [tokens(t) if t else set() for t in texts[i : i + DOCUMENTS]]
            every = set().union(*sets)
            if len(self) + len(every) > self.BOUND:
                self.clear()
            fresh = [t for t in every if t not in self]
            if fresh:
                self.update(zip(fresh, self.words([bare(t) for t in fresh]).tolist(), strict=True))
            out += [max(map(self.__getitem__, s), default=self.bias) for s in sets]
        return out


def _variants(word: str, rng: random.Random) -> list[str]:
    """The word with a character put in, and with one changed."""
    if len(word) < 4:
        return []
    i, j, c = rng.randrange(1, len(word)), rng.randrange(1, len(word)), rng.choice("xzq0134*")
    return [word[:i] + c + word[i:], word[:j] + c + word[j + 1 :]]


def _sentences(text: str, names: dict[str, int]) -> list[np.ndarray]:
    """Distinct words of each sentence, numbered by ``names``."""
    found = ({w for w in map(bare, tokens(s)) if w} for s in _SENTENCE.split(text))
    return [np.array([names.setdefault(w, len(names)) for w in sorted(t)], np.int64) for t in found if t]


def _counted(sets: Iterable[np.ndarray], most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers that stand in ascending sets, in how many each stands); some ``most`` of them are laid side by side."""
    known, count = np.empty(0, np.int64), np.empty(0, np.int32)
    held, size = [], 0

    def merged():
        fresh, often = np.unique(np.concatenate(held), return_counts=True)
        every = np.union1d(known, fresh)
        total = np.zeros(len(every), np.int32)
        total[np.searchsorted(every, known)] += count
        total[np.searchsorted(every, fresh)] += often.astype(np.int32)
        return every, total

    for values in sets:
        held.append(values)
        size += len(values)
        if size >= most:
            known, count = merged()
            held, size = [], 0
    return merged() if held else (known, count)


def _guess(letters: Letters, words: list[str], bags: list[tuple[list[np.ndarray], int]]) -> np.ndarray:
    """A first score for each word: the mean of how much more often its subsequences stand in toxic documents than in clean ones (log ratio)."""
    def of(sentences):
        return np.unique(letters.parts([words[i] for i in np.unique(np.concatenate(sentences))])[1])

    known, up = _counted(of(s) for s, y in bags if y and s)
    down, total = np.zeros(len(known), np.int32), Counter(y for _, y in bags)
    for sentences, y in bags:
        if not y and sentences:
            at, good = _place(of(sentences), known)
            down[at[good]] += 1
    ratio, low = up + 0.5, down + 0.5
    for x, y in ((ratio, 1), (low, 0)):  # in place
        x /= total[y] + 1
        np.log(x, out=x)
    ratio -= low
    del up, down, low
    out = np.zeros(len(words))
    for first, some in _chunks(words, LAID):
        word, code, weight = letters.parts(some)
        at, good = _place(code, known)
        size = np.bincount(word, weight, len(some))
        out[first : first + len(some)] = np.bincount(word, weight * np.where(good, ratio[at], -1.0), len(some)) / np.maximum(size, 1e-9)
    return out


def _evidence(toxic: list[np.ndarray], clean: list[np.ndarray], n: int) -> np.ndarray:
    """For each word, how sure it is that toxic documents have it more often than clean ones (log-likelihood ratio)."""
    a, b = (np.bincount(np.concatenate(x), minlength=n).astype(float) for x in (toxic, clean))
    p, q, r = a / len(toxic), b / len(clean), (a + b) / (len(toxic) + len(clean))

    def fit(k, m, share):
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (m - k) * np.log(1 - share)

    ratio = 2 * (fit(a, len(toxic), p) + fit(b, len(clean), q) - fit(a, len(toxic), r) - fit(b, len(clean), r))
    return np.where(p > 2 * q, ratio, 0.0)


def train(rows: list[tuple[str, int]], totals: dict[int, int] | None = None) -> dict | None:
    """The model of labelled texts: alphabet, weights of subsequences, bias, and the two numbers of the score's logistic curve. Every fourth text is kept for the curve, in which each label weighs as in ``totals`` (rows of each label of which the sample was taken). None where a label is missing."""
    fit, curve = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    if not any(y for _, y in fit) or all(y for _, y in fit):
        return None
    names: dict[str, int] = {}
    bags = [(_sentences(t, names), y) for t, y in fit]
    bags = [(s, y) for s, y in bags if s]
    if not any(y for _, y in bags) or all(y for _, y in bags):
        return None
    words = list(names)
    letters = Letters("".join(sorted({c for w in words for c in w} - {"^"})))
    score = _guess(letters, words, bags)
    given_back()
    documents = [(np.unique(np.concatenate(s)), y) for s, y in bags]
    evidence = _evidence([d for d, y in documents if y], [d for d, y in documents if not y], len(words))
    told = evidence >= EVIDENCE

    def best(of: np.ndarray) -> int:
        return int(of[np.argmax(score[of])]) if len(of) else -1

    # Of toxic documents, the words that the labels speak of; of clean ones, the others.
    toxic = [[t for x in s if len(t := x[told[x]])] for s, y in bags if y]
    clean = [t for d, y in documents if not y and len(t := d[~told[d]])]
    if not any(toxic) or not clean:
        return None
    marked = Counter(best(np.concatenate(s)) for s in toxic if s)
    plain = Counter(map(best, clean))
    usual = np.bincount(np.concatenate(clean), minlength=len(words))
    order = lambda c: [i for i, _ in sorted(c.items(), key=lambda x: (-x[1], words[x[0]]))]
    landmarks = order(marked)[: LANDMARKS // 3]
    landmarks += order(plain)[: LANDMARKS // 3]
    landmarks += [i for i in np.argsort(-usual, kind="stable").tolist() if usual[i] and i not in set(landmarks)][: LANDMARKS - len(landmarks)]
    kernel = Kernel([words[i] for i in landmarks], letters)
    clean_words = np.flatnonzero(usual)
    negative: dict[int, None] = {}
    held: dict[int, np.ndarray] = {}
    floor, weights, bias = math.inf, None, 0.0
    for _ in range(ROUNDS):
        positive: Counter[int] = Counter()
        for sentences in toxic:
            tops = [best(x) for x in sentences]
            if tops:
                positive.update({i for i in tops if score[i] > floor} | {max(tops, key=lambda i: (score[i], -i))})
        negative.update(dict.fromkeys(map(best, clean)))
        negative.update(dict.fromkeys(clean_words[np.argsort(-score[clean_words], kind="stable")[:MINED]].tolist()))
        chosen = list(positive)
        rng = random.Random(1)
        altered = [v for i in sorted(chosen, key=words.__getitem__) if not usual[i] for v in _variants(words[i], rng)]
        fresh = [i for i in [*chosen, *negative] if i not in held]
        if fresh:
            held.update(zip(fresh, kernel.features([words[i] for i in fresh]), strict=True))
        x = np.concatenate((np.array([held[i] for i in chosen]), kernel.features(altered), np.array([held[i] for i in negative])))
        y = np.array([1.0] * (len(chosen) + len(altered)) + [-1.0] * len(negative))
        # A word counts by the documents that show it and by what is known of it.
        up = np.array([positive[i] ** 0.5 * min(1.0, evidence[i] / (4 * EVIDENCE)) for i in chosen])
        cost = np.concatenate((4.0 * up, np.full(len(altered), 0.5), np.full(len(negative), 1.0)))
        weights, bias = svm(x.astype(np.float64), y, cost)
        model = {"letters": letters.letters, "codes": kernel.codes, "weights": kernel.folded(weights), "bias": bias, "slope": 4.0, "shift": 0.0}
        score, floor = Scores(model).words(words), 0.0
    margin, label = np.array(Scores(model).documents([t for t, _ in curve])), np.array([float(y) for _, y in curve])
    weigh = np.ones(len(label))
    if totals:
        taken = Counter(y for _, y in rows)
        weigh = np.array([totals[int(y)] / taken[int(y)] for y in label])
    model["slope"], model["shift"] = _curve(margin, label, weigh / weigh.mean())
    return model


def _curve(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with targets drawn in by a pseudo-count (Platt)."""
    if not len(y) or y.min() == y.max():
        return 4.0, 0.0
    up, down = (weigh * y).sum(), (weigh * (1 - y)).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.array([4.0, 0.0])
    rows = np.stack((x, np.ones(len(x))), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ a, -30, 30)))
        h = (rows * (weigh * p * (1 - p) + 1e-9)[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, rows.T @ (weigh * (target - p)) - 1e-3 * (a - [4.0, 0.0]))
        a = a + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(a[0], 0.1)), float(a[1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "toxic", bound: dict[int, int] | None = None) -> dict | None:
    totals = {int(r[0]): r[1] for r in labels.where(F.col(target).isin(0, 1) & F.col(key).isNotNull() & ~labelled.held_out(key)).groupBy(F.col(target).cast("int")).count().collect()}  # two rows
    rows = labelled.sample(docs, labels, target, key, text, bound)
    released(docs.sparkSession)  # what the collected rows took in the JVM goes before the training needs memory
    try:
        return train(rows, totals if len(totals) == 2 else None)
    finally:
        del rows
        given_back()


def score(docs: DataFrame, model: dict | None, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with their scores, 0 to 1. Only the text goes to Python."""
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        scores = Scores(m)
        try:
            for part in parts:
                margin = np.array(scores.documents(part), float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["shift"], -30, 30))))
        finally:
            scores.clear()
            given_back(False)

    return docs.withColumn(into, of(F.col(text)))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, held_out, score, predicted for each row."""
    model = learn(docs, labels, key, text)
    rows = score(docs.select(key, text), model, text, "score")
    return rows.select(key, labelled.held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
