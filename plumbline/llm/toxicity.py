"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

Kernel. A word is seen through all its subsequences of three letters within SPAN letters, weighted by DECAY to
the power of the letters they stretch over (a word's first and last place count as letters); two words are as similar as the product of these profiles, scaled by length and
cubed (below FAINT: not at all). Inserted, doubled or missing letters and dots between letters leave most subsequences in place.

Features. LANDMARKS words stand for the whole space (Nyström). A sentence is as similar to a landmark as its most similar word; these similarities,
turned by the inverse root of the landmarks' own kernel matrix, are its coordinates. Sentences of more than PASSAGE / 2 tokens are read in windows of
PASSAGE tokens, one every PASSAGE / 2 tokens.

Training. A bounded sample of labelled rows (SAMPLE of each label, chosen by the ids' hash) is cut into sentences. Every sentence, with its text's label, is a row of a linear SVM
(squared hinge); the Newton steps' sums are added up by the tasks. Half of the landmarks are the words, or beginnings of BEGINNING letters, with the most evidence (G statistic)
for toxic texts, however many there are and without a least value, at most two of a stem; the others are words chosen by their hash. Evidence chooses and scales landmarks (those with little
cost more to weigh), never rows.
The driver sees lists and matrices bounded by the number of landmarks and, for the curve, by the sample.

Landmarks whose weight is below FELT of the largest are left out of the model.

Scoring. A text's evidence is the margin of its most suspicious window, those of the second and third most suspicious half window (halves don't overlap), so that a mild word
that comes back counts, and the logarithm of its length. A logistic curve over these four (Platt's, the classes weighted evenly) gives 0..1; its exponent
is the text's margin. Runs of four or more single letters are also read as one word. The whole text is read, whatever its length.
Each worker keeps the similarities of the words it met last (about CACHE words, similarities in STEPS steps, one byte each): when half of them are new, the older half is forgotten.

Cases: null, empty and wordless texts are scored as sentences without any known subsequence. Labels that are null, or of
ids without a document, teach nothing; neither do ids with both labels. Repeated labels, and rows that agree in text and label, count once; rows of one id with different texts
all count. With no toxic or no clean labels the score is that share for every text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import SPACE, held, narrow, span_hashes, written

LETTERS = 40
SPAN = 7
DECAY = 0.7
WINDOW = 24
FIRST, LAST = "<>"
LANDMARKS = 128
SAMPLE = {1: 4_000, 0: 12_000}
PASSAGE = 16
BEGINNING = 5
SHARE = 0.5
RIDGE = 0.05
PENALTY = 2.0
DOUBT = 20.0
FAINT = 0.01
NEAR = 0.999 * FAINT ** (1 / 3)  # whatever is rounded, a product below this is faint
SPELLED = 4
CACHE = 300_000
STEPS = 255
BLOCK = 1 << 18
TOPS = 3
FURTHER = 3.0
FELT = 0.02

_TOKEN = re.compile(r"[^\W\d_]+")
MARKS = ".,;:!?()\"'"
_MARKS = MARKS.encode()
_LETTER = ~SPACE & ~np.isin(np.arange(256), list(_MARKS))  # what is neither space nor mark
_ENDS = np.isin(np.arange(256), list(b".!?"))
_WIDTH = np.ones(256, np.int64)  # of a letter, by its first byte
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


def units(token: str) -> list[str]:
    """The words that a token of the text may stand for: its letter runs, and all its letters together."""
    return units_of(token.lower())


def units_of(lower: str) -> list[str]:
    """``units`` of a token in lower case."""
    core = lower.strip(MARKS)
    if core.isalpha() and len(core) <= WINDOW:
        return [FIRST + core + LAST]
    runs = [core] if core.isalpha() else _TOKEN.findall(lower)
    if len(runs) > 1:
        runs.append("".join(runs))
    out = []
    for word in runs:
        if len(word) <= WINDOW:
            out.append(FIRST + word + LAST)
        else:
            out += [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]
    return out


@lru_cache(maxsize=64)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of the subsequences of a word of this length and their weights, scaled to length one."""
    at = [(a, b, c) for a in range(length) for b in range(a + 1, min(length, a + SPAN)) for c in range(b + 1, min(length, a + SPAN))]
    weight = np.array([DECAY ** (c - a + 1) for a, _, c in at], np.float32)
    return np.array(at, np.int64).reshape(-1, 3), weight / max(1e-9, float(np.sqrt((weight**2).sum())))


def _codes(words: list[str], length: int) -> np.ndarray:
    """(subsequences, words) of table indices."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).T.astype(np.int32)
    letters = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (LETTERS - 28))
    letters = np.where(points == ord(FIRST), LETTERS - 2, np.where(points == ord(LAST), LETTERS - 1, letters)).astype(np.int32)
    at, _ = _places(length)
    return (letters[at[:, 0]] * LETTERS + letters[at[:, 1]]) * LETTERS + letters[at[:, 2]]


class Profiles:
    """The landmarks' subsequences as a sparse table: for each subsequence, the landmarks that hold it and their weights."""

    def __init__(self, landmarks: list[str]) -> None:
        self.size = len(landmarks)
        held: dict[int, dict[int, float]] = {}
        for j, word in enumerate(landmarks):
            if len(word) >= 3:
                for code, weight in zip(_codes([word], len(word))[:, 0].tolist(), _places(len(word))[1].tolist()):
                    row = held.setdefault(code, {})
                    row[j] = row.get(j, 0.0) + weight
        self.start = np.zeros(LETTERS**3 + 1, np.int64)
        for code, row in held.items():
            self.start[code + 1] = len(row)
        self.count = self.start[1:].astype(np.uint8 if self.size < 256 else np.int32)
        self.start = np.cumsum(self.start)
        pairs = [pair for code in sorted(held) for pair in sorted(held[code].items())]
        self.landmark = np.array([j for j, _ in pairs], np.int64)
        self.weight = np.array([w for _, w in pairs], np.float64)

    def products(self, codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(words, landmarks) products of words' profiles, given as columns of subsequences, with the landmarks'."""
        words = codes.shape[1]
        n = self.count[codes].ravel()
        held = np.flatnonzero(n)
        place = held // words
        word = held - place * words
        n, first = n[held].astype(np.int64), self.start[codes.ravel()[held]]
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        cell = np.repeat(word * self.size, n) + self.landmark[at]
        return np.bincount(cell, np.repeat(weight[place], n) * self.weight[at], words * self.size).reshape(words, self.size)


def kernel(words: list[str], seen: Profiles) -> np.ndarray:
    """(words, landmarks) similarities."""
    out = np.zeros((len(words), seen.size), np.float32)
    for rows, found in similar(words, seen):
        out[rows] = found
    return out


def similar(words: list[str], seen: Profiles) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``words`` and similarities, batch by batch, of the words that are like some landmark."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, rows in by_length.items():
        weight = _places(length)[1]
        for low in range(0, len(rows) if length >= 3 else 0, 1024):
            part = rows[low : low + 1024]
            out = seen.products(_codes([words[i] for i in part], length), weight).astype(np.float32)
            out[out < NEAR] = 0
            held = np.flatnonzero(out)
            value = np.minimum(out.ravel()[held] ** 3, 1)  # a word of one letter again and again holds its subsequences many times
            out.ravel()[held] = np.where(value < FAINT, 0, value)
            like = np.flatnonzero(out.any(1))
            yield np.array(part)[like], out[like]


def squared_hinge(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Weights, bias last, of a linear SVM with squared hinge loss, by Newton steps on the active rows.

    ``sums`` gives, for weights, the active rows' weighted x x' and y x.
    """
    ridge = penalty * np.eye(size + 1)
    ridge[-1, -1] = 1e-8
    w = np.zeros(size + 1)
    for _ in range(steps):
        square, target = sums(w)
        new = np.linalg.solve(ridge + square, target)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def platt(evidence: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights, the constant last, of the logistic curve, with Platt's smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(label > 0, n0 / n1, 1.0)
    x = np.hstack([evidence, np.ones((len(evidence), 1))])
    # the best window explains what it can; the other evidence has to earn its weight
    ridge = np.diag([0.01] + [FURTHER] * (x.shape[1] - 2) + [0.01])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (share * (p - target)) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """What a fit gives: bounded by the number of landmarks."""

    landmarks: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = -1.0
    curve: list[float] = field(default_factory=lambda: [1.0] + [0.0] * (TOPS + 1))
    slope: float = 1.0
    shift: float = 0.0
    share: float | None = None  # the constant score, if only one label was there


class Reader(dict):
    """Reads texts as windows of similarities. core -> 8 x its row of ``table``, where a core is a token in lower case without the marks around it.

    ``older`` holds cores that were met before those in the dictionary itself.
    """

    def __init__(self, landmarks: list[str]) -> None:
        super().__init__()
        self.seen = Profiles(landmarks)
        self.forget()

    def __missing__(self, token: bytes) -> int:
        core = token.lower().strip(_MARKS)
        return self[core] if core in self else self.older[core]

    def forget(self) -> None:
        self.clear()
        self.older: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.seen.size), np.uint8)
        self.rows = 1  # row 0: like no landmark

    def age(self) -> None:
        """Forgets the older cores and their rows; the others become the older ones."""
        row = np.fromiter(self.values(), np.int64, len(self)) >> 3
        kept = np.unique(np.append(row, 0))
        self.older = dict(zip(self, (8 * np.searchsorted(kept, row)).tolist()))
        self.clear()
        self.table, self.rows = self.table[kept], len(kept)

    def _added(self, near: np.ndarray) -> int:
        """The first of the new rows."""
        first, self.rows = self.rows, self.rows + len(near)
        if self.rows > len(self.table):
            self.table = np.concatenate((self.table, np.zeros((max(self.rows, len(self.table)), self.seen.size), np.uint8)))
        self.table[first : self.rows] = near
        return first

    def learn(self, tokens: list[bytes]) -> None:
        cores = list({t.lower().strip(_MARKS) for t in tokens})
        for low in range(0, len(cores), 20_000):
            part = cores[low : low + 20_000]
            # no token holds a space, so all are decoded at once
            plain = b" ".join(part).decode("utf-8", "replace").lower().split(" ")
            # most cores are one word; what the others may stand for follows
            words = [FIRST + core + LAST if core.isalpha() and len(core) <= WINDOW else "" for core in plain]
            others = {i: units_of(plain[i]) for i, word in enumerate(words) if not word}
            flat = words + [w for ws in others.values() for w in ws]
            row = np.zeros(len(flat), np.int64)
            for places, near in similar(flat, self.seen):
                row[places] = np.arange(len(places)) + self._added(np.rint(near * STEPS).astype(np.uint8))
            at = len(words)
            for i, ws in others.items():
                rows, at = [r for r in row[at : at + len(ws)].tolist() if r], at + len(ws)
                if rows:
                    row[i] = rows[0] if len(rows) == 1 else self._added(self.table[rows].max(0)[None])
            self.update(zip(part, (8 * row[: len(part)]).tolist()))

    def codes(self, cores: list[bytes]) -> list[int]:
        """The codes of single cores; new ones are learned."""
        if len(self) > CACHE // 2:
            if len(self) > CACHE:
                self.forget()
            else:
                self.age()
        found = list(map(self.get, cores))
        missing = [c for c, code in zip(cores, found) if code is None]
        self.update((c, self.older[c]) for c in missing if c in self.older)
        self.learn([c for c in missing if c not in self])
        return [self[c] if code is None else code for c, code in zip(cores, found)]

    def _codes_at(self, data: bytes, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The codes of the tokens from ``begin`` to ``end``. Only one of equal cores is made an object and looked up."""
        letter = np.flatnonzero(_LETTER[raw])
        first, behind = np.searchsorted(letter, begin), np.searchsorted(letter, end)
        core = first < behind  # the others are marks only
        low, high = begin.copy(), begin.copy()
        low[core], high[core] = letter[first[core]], letter[behind[core] - 1] + 1
        _, at, place = np.unique(span_hashes(raw, low, high), return_index=True, return_inverse=True)
        lower = data.lower()
        there = [lower[a:b] for a, b in zip(low[at].tolist(), high[at].tolist())]
        return np.array(self.codes(there), np.int64)[place]

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Similarities (windows, landmarks) and each one's place in ``texts``, then the same of half windows; what is like no landmark is left out."""
        data = b"\n".join(texts)
        raw = np.frombuffer(data, np.uint8)
        space = np.concatenate(([True], SPACE[raw], [True]))
        begin, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        code = self._codes_at(data, raw, begin, end)
        ends, single = _ENDS[raw[end - 1]], end - begin == _WIDTH[raw[begin]]
        line = np.searchsorted(np.flatnonzero(raw == ord("\n")), begin)
        new_line = np.diff(line, prepend=-1) > 0
        low = np.cumsum([0] + [len(t) + 1 for t in texts])
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, low)))
        spelled, owner = self._spelled(data, begin, end, single, new_line, text)
        first = new_line | np.concatenate(([True], ends[:-1]))[: len(ends)]
        # halves begin with a sentence, and every PASSAGE / 2 tokens in it
        place = np.arange(len(code))
        begin = np.maximum.accumulate(np.where(first, place, 0))
        step = PASSAGE // 2
        number = np.cumsum((place - begin) % step == 0) - 1
        near = np.flatnonzero(code >= 8)
        if not len(near):
            return spelled, owner, spelled, owner
        of = number[near]
        start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        row, size = code[near] >> 3, np.diff(start, append=len(near))
        half = self.table.take(row[start], 0)
        for k in range(1, step):
            more = np.flatnonzero(size > k)
            half[more] = np.maximum(half[more], self.table.take(row[start[more] + k], 0))
        half = half.astype(np.float32) / STEPS
        of, at = of[start], near[start]
        ends = np.append(np.flatnonzero(first)[1:], len(code))[np.cumsum(first) - 1][at]
        inside, halves = (at - begin[at]) // step, -(-(ends - begin[at]) // step)
        # a window is a half and the next one of its sentence; a half behind one that is like no landmark is a window with that one
        follows = np.flatnonzero((of[1:] == of[:-1] + 1) & (begin[at[1:]] == begin[at[:-1]]))
        joined = half.copy()
        joined[follows] = np.maximum(half[follows], half[follows + 1])
        behind = np.zeros(len(of), bool)
        behind[follows + 1] = True
        opens, shut = (inside < halves - 1) | (halves == 1), (inside > 0) & ~behind
        whole = np.concatenate((joined[opens], half[shut], spelled))
        return whole, np.concatenate((text[at[opens]], text[at[shut]], owner)), np.concatenate((half, spelled)), np.concatenate((text[at], owner))

    def _spelled(self, data: bytes, begin: np.ndarray, end: np.ndarray, single: np.ndarray, new_line: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of SPELLED or more single letters of a line, each a window of one word."""
        at = np.flatnonzero(single)
        opens = np.flatnonzero(new_line[at] | (np.diff(at, prepend=-2) > 1))
        runs = [(at[a], at[b - 1]) for a, b in zip(opens, [*opens[1:], len(at)]) if b - a >= SPELLED]
        words = [units(b"".join(data[begin[a] : end[b]].split()).decode("utf-8", "replace")) for a, b in runs]
        flat = [w for ws in words for w in ws]
        owner = np.array([text[a] for (a, _), ws in zip(runs, words) for _ in ws], np.int64)
        found = kernel(flat, self.seen)
        near = found.any(1)
        return found[near], owner[near]


def blocks(values: list, size: Callable = len) -> Iterator[tuple[int, int]]:
    """Runs of values of about BLOCK bytes; a longer one is a run by itself."""
    low = total = 0
    for at, value in enumerate(values):
        if at > low and total + size(value) > BLOCK:
            yield low, at
            low, total = at, 0
        total += size(value)
    if low < len(values):
        yield low, len(values)


def reader(landmarks: list[str]) -> Reader:
    return held(("reader", zlib.crc32(repr(landmarks).encode())), lambda: Reader(landmarks))


def text_evidence(texts: list[bytes], model: Model) -> np.ndarray:
    """For each text the best margin of a window, the next best margins of half windows, and its length, block by block."""
    known, weights = reader(model.landmarks), np.array(model.weights)
    out = np.full((len(texts), TOPS + 1), model.bias)
    out[:, TOPS] = np.log1p(np.array([len(t) for t in texts], float) / 200)
    for low, high in blocks(texts):
        whole, of, half, owner = known.windows(texts[low:high])
        np.maximum.at(out[:, 0], of + low, whole @ weights + model.bias)
        margin = half @ weights + model.bias
        order = np.lexsort((-margin, owner))
        owner, margin = owner[order], margin[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        good = (rank > 0) & (rank < TOPS)
        out[low + owner[good], rank[good]] = np.maximum(margin[good], model.bias)
    return out


def text_margins(texts: list[bytes], model: Model) -> np.ndarray:
    return text_evidence(texts, model) @ np.array(model.curve[:-1]) + model.curve[-1]


class Margins:
    """The margins of single texts."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def of_texts(self, texts: list[bytes]) -> list[float]:
        return text_margins(texts, self.model).tolist()


def sampled(docs: DataFrame, labels: DataFrame, sample: dict[int, int]) -> DataFrame:
    """doc_id, text (bytes) and toxic of the bounded sample: the labelled rows with the smallest id hashes."""
    given = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).filter("labelled is not null and toxic is not null")
    known = given.groupBy("labelled").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    parts = [known.filter(F.col("toxic") == label).orderBy(F.xxhash64("labelled"), "labelled").limit(n) for label, n in sorted(sample.items())]
    chosen = written(parts[0].union(parts[1]))
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", F.col("text").cast("binary").alias("text"), "toxic")
    return written(texts.dropDuplicates(["text", "toxic"]))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, word and the number of texts that hold it, added up per batch."""
    for batch in batches:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            count = counts[toxic]
            whole = {w for t in set(text.as_py().split()) for w in units(t.decode("utf-8", "replace"))}
            for word in whole | {w[: BEGINNING + 1] for w in whole if w[0] == FIRST and len(w) > BEGINNING + 2}:
                count[word] = count.get(word, 0) + 1
        for toxic, count in enumerate(counts):
            yield pa.record_batch([pa.array([toxic] * len(count), pa.int32()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                  names=["toxic", "word", "n"])


def landmark_words(rows: DataFrame, totals: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """Half of the landmarks by evidence for toxic texts, the others by hash; and each one's evidence beyond what chance gives."""
    each = rows.select("toxic", "text").mapInArrow(_words, "toxic int, word string, n long")
    counted = each.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    counted = written(counted.filter(F.length("word") >= 5))
    both, share = F.col("t") + F.col("c"), totals[1] / (totals[1] + totals[0])
    part = lambda seen, exp: F.when(seen > 0, 2 * seen * F.log(seen / exp)).otherwise(0.0)
    judged = counted.withColumn("g", F.when(F.col("t") > both * share, part(F.col("t"), both * share) + part(F.col("c"), both * (1 - share))).otherwise(0.0))
    chosen: dict[str, float] = {}
    for r in judged.filter("g > 0").orderBy(F.desc("g"), F.desc(F.length("word")), "word").limit(20 * LANDMARKS).collect():
        core = r["word"].strip(FIRST + LAST)
        alike = sum(core in other.strip(FIRST + LAST) or other.strip(FIRST + LAST) in core for other in chosen)
        if len(chosen) < LANDMARKS // 2 and alike < 2:
            chosen[r["word"]] = r["g"]
    for r in judged.filter(F.endswith("word", F.lit(LAST))).orderBy(F.xxhash64("word"), "word").limit(LANDMARKS).collect():
        if len(chosen) < LANDMARKS:
            chosen.setdefault(r["word"], r["g"])
    # without any connection, the best of n words comes to about 2 ln n
    chance = 2 * np.log(max(1, counted.count()))
    return list(chosen), np.maximum(np.array(list(chosen.values())) - chance, 0)


def coordinates(landmarks: list[str], evidence: np.ndarray) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix, its rows scaled by what is known of each landmark: a doubtful one needs a greater weight."""
    return np.maximum(0.05, evidence / (evidence + DOUBT))[:, None] * inverse_root(landmarks)


def inverse_root(landmarks: list[str]) -> np.ndarray:
    values, vectors = np.linalg.eigh(kernel(landmarks, Profiles(landmarks)).astype(float) + RIDGE * np.eye(len(landmarks)))
    return (vectors / np.sqrt(np.maximum(values, RIDGE))) @ vectors.T


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None) -> Model:
    """The model learned from ``labels`` (doc_id, toxic); the caller leaves held-out labels away."""
    rows = sampled(narrow(docs, id_col, text_col), labels, sample or SAMPLE)
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(share=n1 / (n1 + n0) if n1 + n0 else 0.0)
    landmarks, evidence = landmark_words(rows, totals)
    if not landmarks:
        return Model(share=n1 / (n1 + n0))
    root = coordinates(landmarks, evidence)
    taught = written(_features(rows, landmarks))
    sentences = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    # all sentences of toxic texts together weigh SHARE of the clean ones
    w = squared_hinge(lambda at: _active_sums(taught, root, at, SHARE * sentences[0] / sentences[1]), len(landmarks))
    weights = root @ w[:-1]
    felt = np.flatnonzero(np.abs(weights) >= FELT * np.abs(weights).max(initial=0.0))
    model = Model([landmarks[i] for i in felt], weights[felt].tolist(), float(w[-1]))
    model.curve = platt(*_evidence(rows, model)).tolist()
    return model


def _evidence(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The evidence and the label of each row of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_evidence(batch.column("text").to_pylist(), model)
            yield pa.record_batch([batch.column("toxic"), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["toxic", "evidence"])

    pairs = rows.select("toxic", "text").mapInArrow(run, "toxic int, evidence array<double>").toPandas()
    return np.array(pairs["evidence"].tolist()).reshape(-1, TOPS + 1), pairs["toxic"].to_numpy(float)


def text_features(texts: list[bytes], known: Reader) -> list[np.ndarray]:
    """For each text the similarities of its windows; those like no landmark are one row for the text."""
    out: list[np.ndarray] = []
    for low, high in blocks(texts):
        x, owner, _, _ = known.windows(texts[low:high])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(high - low + 1))
        nothing = np.zeros((1, known.seen.size), np.float32)
        out += [np.concatenate((x[order[a:b]], nothing)) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _features(rows: DataFrame, landmarks: list[str]) -> DataFrame:
    """toxic, n and x of every text: its number of windows and their similarities in STEPS steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reader(landmarks)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                x = text_features(part.column("text").to_pylist(), known)
                yield pa.record_batch([part.column("toxic"), pa.array([len(m) for m in x], pa.int64()), pa.array([np.rint(m * STEPS).astype(np.uint8).tobytes() for m in x], pa.binary())],
                                      names=["toxic", "n", "x"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, n long, x binary")


def newton_sums(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted x x' and, in the last column, y x of the rows with a hinge below 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    active = y * (x @ w) < 1
    a = x[active] * c[active, None]
    return np.hstack([a.T @ x[active], (a.T @ y[active])[:, None]])


def _active_sums(taught: DataFrame, root: np.ndarray, w: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The sums that a Newton step needs, added up by the tasks over plain similarities and turned by ``root`` here."""
    size = len(w)
    turn = np.eye(size)
    turn[:-1, :-1] = root
    plain = turn @ w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.uint8).reshape(-1, size - 1).astype(np.float32) / STEPS
                toxic = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False) == 1, part.column("n").to_numpy(zero_copy_only=False))
                total += newton_sums(x, np.where(toxic, 1.0, -1.0).astype(np.float32), np.where(toxic, weight, 1.0).astype(np.float32), plain.astype(np.float32))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = taught.mapInArrow(run, "total binary").collect()
    total = turn.T @ sum(np.frombuffer(r["total"]).reshape(size, size + 1) for r in parts)
    return total[:, :-1] @ turn, total[:, -1]


def _margin_rows(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, margin and the kept columns of rows with doc_id and text (bytes)."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", "margin double", *(f"{c} {kinds[c]}" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = pa.array(text_margins(batch.column("text").to_pylist(), model), pa.float64())
            yield pa.record_batch([batch.column("doc_id"), margins, *(batch.column(c) for c in keep)], names=["doc_id", "margin", *keep])

    return rows.mapInArrow(run, schema)


def probability(model: Model, margin: Column) -> Column:
    """The score of a margin."""
    if model.share is not None:
        return F.lit(float(model.share))
    return 1 / (1 + F.exp(-(margin * model.slope + model.shift)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, margin and score, one row for each row of ``docs``."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return _margin_rows(rows, model).withColumn("score", probability(model, F.col("margin")))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(text_margins(batch.to_pylist(), model), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    margin = F.arrow_udf(run, "double")(F.coalesce(ref(text_col), F.lit("")).cast("binary"))
    return docs.filter(probability(model, margin) < limit)


def teaching(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fifth."""
    return labels.filter(~held_out("doc_id"))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
