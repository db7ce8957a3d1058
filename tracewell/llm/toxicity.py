"""Toxicity: support vector machine over a subsequence string kernel, with Nystroem landmarks.

Texts are letters and one symbol between words. Latin letters are folded to A-Z; digits and signs that stand for a letter
count as that letter beside another one; letters of other scripts are four symbols of their own, by their code point; an
apostrophe after one or two letters parts words; other characters are left out. The kernel counts
common subsequences of LETTERS letters with up to GAP places from one to the next, each skipped place
costing a factor DECAY; so "i.d.i.o.t" and "idxiot" share most of what "idiot" has. Landmarks are
the words that set toxic from clean training texts apart, frequent clean words, and the clean passages
that come closest to toxic ones. A sentence's
kernel values against the landmarks, times the inverse root of the landmark kernel, are its features.

Labels belong to documents, so training is by multiple instances: of a clean document its worst sentence
window counts, of a toxic one those that hold most of a landmark or that the machine finds toxic; the machine is fitted on those (squared hinge, Newton), and windows are chosen
again and added. The machine is linear in subsequence counts, so a text is scored by sliding sums in numpy; a logistic curve over
a document's worst window and the amount of toxic windows gives its probability.

Training takes at most `max_labelled` labelled rows (smallest hashes of the id). Nulls: null texts are
empty; an empty text scores as a text without any landmark subsequence. Labels with a null id or value
are left out, and of several labels of an id the largest counts. Without both labels, or without any
word that toxic texts share, all scores are 0.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bucket_of_id, small_batches, staged, text_of
from tracewell.llm.quality import labelled_sample

LETTERS, GAP, DECAY = 4, 3, 0.75
WINDOW = 12
SPACE = 28  # the symbol between words
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 120, 40
MAX_LABELLED = 8_000
ROUNDS = 3
CHANCE_MARGIN = 3.0  # log odds times documents beyond the log of the number of words
HARD_LANDMARKS = 80  # clean windows added in each round
WINDOWS = 4  # looked at in each training document
START_MARGIN = 0.7  # share of a landmark that a training window has to hold at first
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_PAD = 3 * GAP + WINDOW
_GROUP = 1 << 21
_ROWS = 500  # windows handled together in training


OTHER = (27, 29, 30, 31)  # letters of other scripts
_OUT, _LIKE, _APOSTROPHE, _CODES = 255, 64, 128, 0x30000
# fixed values: letters that Unicode does not take apart, and what is written for a letter
_WHOLE = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "đ": "d", "ð": "d", "þ": "t", "ł": "l", "ı": "i", "ħ": "h"}
_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@cache
def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 1 to 26 letters, OTHER ones, SPACE; _LIKE and a letter; _APOSTROPHE; _OUT."""
    table = np.full(_CODES + 1, _OUT, np.uint8)
    for code in range(0x80, _CODES):
        if not 0xD800 <= code < 0xE000 and unicodedata.category(chr(code))[0] == "L":
            base = unicodedata.normalize("NFKD", chr(code))[0].lower()
            base = _WHOLE.get(base, base)
            table[code] = ord(base) - 96 if "a" <= base <= "z" else OTHER[code % len(OTHER)]
    for i in range(26):
        table[65 + i] = table[97 + i] = i + 1
    table[[9, 10, 11, 12, 13, 32, 0xA0]] = SPACE
    for sign, letter in _ALIKE.items():
        table[ord(sign)] = _LIKE + ord(letter) - 96
    table[[ord("'"), 0x2019]] = _APOSTROPHE
    return table


def _between_words(s: np.ndarray) -> np.ndarray:
    """Apostrophes after one or two letters become spaces, as in l'ami; others go."""
    wide = np.concatenate([np.full(3, SPACE, np.uint8), s])
    at = np.flatnonzero(s == _APOSTROPHE) + 3
    one, two, three = ((wide[at - back] == SPACE) | (wide[at - back] == _APOSTROPHE) for back in (1, 2, 3))
    wide[at] = np.where(~one & (two | three), SPACE, _OUT)
    wide = wide[3:]
    return wide[wide != _OUT]


def _likenesses(s: np.ndarray) -> np.ndarray:
    """Signs that stand for a letter become it beside a letter, or beside another one that did; others go."""
    wide = np.concatenate([np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)])
    at = np.flatnonzero(wide > _LIKE)
    for _ in range(2):
        left, right = wide[at - 1], wide[at + 1]
        beside = ((left > 0) & (left < 27)) | ((right > 0) & (right < 27))
        wide[at[beside]] -= _LIKE
        at = at[~beside]
    wide = wide[1:-1]
    return wide[wide < _LIKE]


def symbols(text: bytes) -> np.ndarray:
    """Folded letters with one SPACE between words; letters that stand alone in a row are one word."""
    if text.isascii():
        s = _symbol_table()[np.frombuffer(text, np.uint8)]
    else:
        s = _symbol_table()[np.minimum(np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4"), _CODES)]
    s = s[s != _OUT]
    most = s.max(initial=0)
    if most == _APOSTROPHE:
        s = _between_words(s)
    if most > _LIKE:
        s = _likenesses(s)
    gap = s == SPACE
    s = s[~gap | ~np.concatenate([[False], gap[:-1]])] if len(s) else s
    if len(s) > 2:
        gap = np.concatenate([[True], s == SPACE, [True]])
        lone = ~gap[1:-1] & gap[:-2] & gap[2:]
        if lone.any():
            between = np.zeros(len(s), bool)
            between[1:-1] = (s[1:-1] == SPACE) & lone[:-2] & lone[2:]
            s = s[~between]
    return s


def bounded(s: np.ndarray) -> np.ndarray:
    """The string between two word ends."""
    return np.concatenate([[SPACE], s, [SPACE]]).astype(np.uint8)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, apart from each other, and where each begins."""
    pad, parts, starts, at = np.zeros(_PAD, np.uint8), [], [], 0
    for t in texts:
        s = bounded(symbols(t))
        starts.append(at)
        parts += [s, pad]
        at += len(s) + _PAD
    return np.concatenate(parts), np.array(starts)


def _subsequences(s: np.ndarray, live: np.ndarray):
    """(starts, code, weight) of subsequences whose first three letters are live, by gap pattern."""
    n = len(s) - 3 * GAP
    c = s.astype(np.int32)
    for a in range(1, GAP + 1):
        two = (c[:n] << 5) | c[a : n + a]
        for b in range(1, GAP + 1):
            three = (two << 5) | c[a + b : n + a + b]
            at = np.flatnonzero(live[three])
            stem = three[at] << 5
            for d in range(1, GAP + 1):
                yield at, stem | c[at + a + b + d], DECAY ** (a + b + d - 3)


def feature_rows(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, code, weight) of all subsequences in short strings of symbols."""
    pad = np.zeros(3 * GAP, np.uint8)
    s = np.concatenate([x for t in strings for x in (t, pad)]) if strings else pad
    owner = np.repeat(np.arange(len(strings)), [len(t) + len(pad) for t in strings])
    live = np.zeros(1 << 15, bool)
    first = np.arange(1 << 15)
    live[(first >> 10 > 0) & ((first >> 5) & 31 > 0) & (first & 31 > 0)] = True
    found = [(owner[at], codes, np.full(len(at), weight)) for at, codes, weight in _subsequences(s, live)]
    rows, codes, weights = (np.concatenate(x) for x in zip(*found))
    whole = codes & 31 > 0
    return rows[whole], codes[whole], weights[whole]


@dataclass
class Machine:
    """Weight of each subsequence, what to add, and the logistic curve over a document's evidence."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    curve: np.ndarray | None = None

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve[:-1] + self.curve[-1], -30, 30)))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        table, live = np.zeros(1 << 20, np.float32), np.zeros(1 << 15, bool)
        table[self.codes] = self.weights
        live[self.codes >> 5] = True
        return table, live


def window_scores(s: np.ndarray, table: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sum of weights of the subsequences that start in the WINDOW places from each place on."""
    n = len(s) - 3 * GAP
    own = np.zeros(max(n, 0))
    c = s.astype(np.int32)
    for a in range(1, GAP + 1) if n > 0 else ():
        two = ((c[:n] << 5) | c[a : n + a]) << 5
        for b in range(1, GAP + 1):
            three = two | c[a + b : n + a + b]
            at = np.flatnonzero(np.take(live, three, mode="clip"))  # codes are in range; clipping spares their check
            stem, more = three[at] << 5, np.zeros(len(at), np.float32)
            for d in range(1, GAP + 1):
                more += np.float32(DECAY ** (a + b + d - 3)) * np.take(table, stem | c[at + (a + b + d)], mode="clip")
            own[at] += more
    total = np.concatenate([[0.0], np.cumsum(own)])
    return total[WINDOW:] - total[:-WINDOW]


def document_scores(texts: list[bytes], machine: Machine, tables: tuple, best: int = 0) -> tuple[np.ndarray, list[list]]:
    """Evidence of each text (its best window score, and how much of it lies in toxic windows on a log
    scale), and (score, symbols) of its `best` best windows that do not overlap."""
    scores, windows, at = [], [], 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < _GROUP):
            size, end = size + len(texts[end]), end + 1
        s, starts = _joined(texts[at:end])
        found = window_scores(s, *tables) + machine.bias
        toxic = np.add.reduceat((found > 0).astype(float), starts) / WINDOW
        scores.append(np.column_stack([np.maximum.reduceat(found, starts), np.log1p(toxic)]))
        for lo, hi in zip(starts, np.append(starts[1:], len(found))) if best else ():
            own, chosen = found[lo:hi].copy(), []
            for _ in range(best):
                i = int(np.argmax(own))
                chosen.append((own[i], s[lo + i : lo + i + WINDOW + 3 * GAP]))
                own[max(0, i - WINDOW) : i + WINDOW] = -np.inf
            windows.append([c for c in chosen if np.isfinite(c[0])])
        at = end
    return (np.concatenate(scores) if scores else np.zeros((0, 2))), windows


class Landmarks:
    """Landmark strings of symbols, their subsequences, and the map from counts to Nystroem features."""

    def __init__(self, strings: list[np.ndarray], n_toxic: int):
        self.strings, self.n_toxic = strings, n_toxic
        rows, codes, weights = feature_rows(strings)
        self.codes, place = np.unique(codes, return_inverse=True)
        self.phi = np.zeros((len(strings), len(self.codes)))
        np.add.at(self.phi, (rows, place), weights)
        self.length = np.maximum(np.linalg.norm(self.phi, axis=1, keepdims=True), 1e-9)
        self.phi /= self.length
        values, vectors = np.linalg.eigh(self.phi @ self.phi.T)
        good = values > 1e-6
        self.root = vectors[:, good] / np.sqrt(values[good])  # landmark kernel to the power -1/2

    def features(self, strings: list[np.ndarray]) -> np.ndarray:
        to_landmarks = self.phi.T @ self.root
        out = np.zeros((len(strings), self.root.shape[1]), np.float32)
        for at in range(0, len(strings), _ROWS):
            rows, codes, weights = feature_rows(strings[at : at + _ROWS])
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[place] == codes
            counts = np.zeros((len(strings[at : at + _ROWS]), len(self.codes)))
            np.add.at(counts, (rows[known], place[known]), weights[known])
            out[at : at + _ROWS] = counts @ to_landmarks
        return out

    def disguised(self) -> list[np.ndarray]:
        """The toxic landmarks as they are and with one foreign letter at each inner place."""
        found = []
        for letters in self.strings[: self.n_toxic]:
            found += [letters] + [np.insert(letters, i, 27) for i in range(2, len(letters) - 1)]
        return found

    def machine(self, weights: np.ndarray, bias: float) -> Machine:
        return Machine(self.codes, (weights @ self.root.T @ self.phi).astype(np.float32), bias)

    def start(self) -> Machine:
        """Similarity to the toxic landmarks, about 1 for a whole landmark."""
        return Machine(self.codes, (self.phi[: self.n_toxic] / self.length[: self.n_toxic]).max(0).astype(np.float32), -START_MARGIN)


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Linear machine by Newton steps on the squared hinge loss; both classes weigh the same. Rows
    are taken in blocks, so that the features are in memory once."""
    t = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-8
    active = None
    for _ in range(30):
        now = t * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1
        if active is not None and np.array_equal(now, active):
            break
        active, hessian, target = now, penalty.copy(), np.zeros(len(w))
        for at in range(0, len(x), 4 * _ROWS):
            part = at + np.flatnonzero(now[at : at + 4 * _ROWS])
            z = np.column_stack([x[part], np.ones(len(part))]).astype(float)
            rows = z * weight[part, None]
            hessian += rows.T @ z
            target += rows.T @ t[part]
        w = np.linalg.solve(hessian, target)
    return w[:-1], float(w[-1])


def fit_logistic(evidence: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and shift of a logistic curve, by Newton steps with a weak ridge."""
    z = np.column_stack([evidence, np.ones(len(evidence))])
    w, ridge = np.zeros(z.shape[1]), np.array([1e-1] * evidence.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        w -= np.clip(np.linalg.solve(h, z.T @ (p - y) + ridge * w), -2, 2)
    return w


def _words(batches):
    """Distinct folded words of every text with the text's label."""
    letters = np.array([""] + [chr(97 + i) for i in range(26)])
    for batch in batches:
        words, toxic = [], []
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = symbols(t.as_py())
            cut = np.flatnonzero(s >= 27)
            spans = zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(s)]]))
            own = {"".join(letters[s[a:b]]) for a, b in spans if LETTERS <= b - a <= 20}
            words += own
            toxic += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "y"])


def choose_landmarks(train: DataFrame) -> tuple[list[str], int]:
    """Words whose documents are far more often toxic, then frequent words of clean documents."""
    seen = train.select("y", "t").mapInArrow(_words, "word string, y int").groupBy("word").agg(
        F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    seen = staged(seen, "landmark-words")
    total = train.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    odds = F.log(((F.col("toxic") + 0.5) / (total[0] + 1.0)) / ((F.col("clean") + 0.5) / (total[1] + 1.0)))
    # a word has to stand out more than chance lets the best of all words stand out
    least = float(np.log(max(seen.count(), 1)) + CHANCE_MARGIN)
    rank = seen.where("toxic > 1").withColumn("rank", F.col("toxic") * odds).where(F.col("rank") > least)
    toxic = [r["word"] for r in rank.orderBy(F.desc("rank"), "word").limit(TOXIC_LANDMARKS).collect()]
    clean = [r["word"] for r in seen.where("toxic * 4 < clean").orderBy(F.desc("clean"), "word").limit(CLEAN_LANDMARKS).collect()]
    return toxic + [w for w in clean if w not in toxic], len(toxic)


def fit_windows(windows: dict[bytes, int], marks: Landmarks) -> tuple[Machine, Landmarks]:
    """Machine over labelled windows. Clean windows that come closest become landmarks, to be told apart."""
    strings = [np.frombuffer(w, np.uint8) for w in windows] + marks.disguised()
    y = np.concatenate([np.array(list(windows.values())), np.ones(len(strings) - len(windows), int)])
    for step in range(2):
        x = marks.features(strings)
        weights, bias = fit_svm(x, y)
        if step == 0:
            order = np.argsort(np.where(y == 0, -(x @ weights), np.inf), kind="stable")[: min(HARD_LANDMARKS, int((y == 0).sum()))]
            known = {t.tobytes() for t in marks.strings}
            marks = Landmarks(marks.strings + [strings[i] for i in order if strings[i].tobytes() not in known], marks.n_toxic)
    return marks.machine(weights, bias), marks


def train_machine(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_labelled: int) -> Machine | None:
    sample = labelled_sample(labels.select("doc_id", label), label, folds, held_out, max_labelled)
    train = docs.select("doc_id", text_of(F.col("text")).cast("binary").alias("t")).join(F.broadcast(sample), "doc_id")  # bounded
    train = staged(train.groupBy("doc_id").agg(F.min(F.struct("t", "y")).alias("r")).select("doc_id", "r.t", "r.y"), "toxicity-train")
    if train.select("y").distinct().count() < 2:
        return None
    words, n_toxic = choose_landmarks(train)
    if not n_toxic:
        return None
    marks = Landmarks([bounded(symbols(w.encode())) for w in words], n_toxic)
    machine = marks.start()
    windows: dict[bytes, int] = {}
    for _ in range(ROUNDS):
        def worst(batches, machine=machine):
            tables = machine.tables()
            for batch in batches:
                _, windows = document_scores([t.as_py() for t in batch.column(1)], machine, tables, WINDOWS)
                rows = [(y, i, float(v), w.tobytes()) for y, own in zip(batch.column(0).to_pylist(), windows) for i, (v, w) in enumerate(own)]
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["y", "nth", "score", "window"])

        # a clean document's best window is held against the machine; of a toxic one all that pass count
        rows = train.select("y", "t").mapInArrow(worst, "y int, nth int, score double, window binary").where(
            "(nth = 0 and y = 0) or (y = 1 and score > 0)").groupBy("window").agg(F.min("y").alias("y")).orderBy("window").collect()
        windows |= {bytes(r["window"]): r["y"] for r in rows}
        machine, marks = fit_windows(windows, marks)

    def judge(batches):
        tables = machine.tables()
        for batch in batches:
            scores, _ = document_scores([t.as_py() for t in batch.column(1)], machine, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores[:, 0]), pa.array(scores[:, 1])], names=["y", "best", "share"])

    rows = np.array(sorted(map(tuple, train.select("y", "t").mapInArrow(judge, "y int, best double, share double").collect())))
    machine.curve = fit_logistic(rows[:, 1:], rows[:, 0])
    return machine


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT,
                   max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    small_batches(docs.sparkSession)
    machine = train_machine(docs, labels, label, folds, held_out, max_labelled)

    def score(batches):
        tables = machine.tables() if machine else None
        for batch in batches:
            if machine:
                found, _ = document_scores([t.as_py() for t in batch.column(1)], machine, tables)
                p = machine.probability(found)
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text_of(F.col("text")).cast("binary").alias("t")).mapInArrow(score, f"doc_id {id_type}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = (bucket_of_id(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return score_toxicity(docs, labels).select("doc_id", held, "score", "predicted")
