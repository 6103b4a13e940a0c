"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

Kernel: two strings are as alike as the gapped four-letter subsequences they share; an
occurrence that spans s letters weighs DECAY**s, spans go up to SPAN, so skipped and
inserted letters cost a little and don't hide a word.  Before that, letters are folded
(case, common digit and sign stand-ins), marks inside a word are dropped and spelled-out
letters ("i d i o t") are joined.

Training, on a bounded sample of labelled texts (MAX_LABELS): substrings that occur far
more often in toxic than in clean texts become landmarks.  A string is mapped to its kernel values
with the landmarks times K_mm^(-1/2) (Nyström), and a linear SVM learns on sentences of a
part of the sample: the worst word stands for a sentence, the worst
sentences of a toxic text are its witnesses, re-chosen every round.  Toxic witnesses are also learnt with
a letter pushed in.  Logistic curves over a text's largest and its three largest decision values
give the score.

Scoring: the SVM over Nyström features is one weight per four-letter subsequence, so a text
needs one table lookup per occurrence; whole texts are scored, long words in overlapping
windows.

Defined results: a null or empty text, or one without words of three letters, gets the
score of a text without evidence; repeated rows are scored alike; labelled rows that are null,
have no text or disagree (an id labelled both ways) are not learnt from; without any toxic or
any clean label every score is 0; an empty table gives an empty result; other columns
are carried along or ignored as the caller asks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import column, drop_caches, materialize, received, record, shielded, shipped, slices

DECAY, SPAN, LETTERS = 0.7, 6, 4
CODES = 32
WINDOW, STRIDE = 16, 8
START = "^"  # stands before every word, so how a word begins counts
MAX_LABELS = 12_000  # labelled texts learnt from
FIT_LETTERS = 16 << 20  # letters of the texts that the SVM is fitted on, all together
GRAM_LETTERS = 1 << 20  # letters whose substrings a task counts at a time
TOP = 3  # a text's largest decision values that its score is made from
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
GAPS = [(0, *rest) for rest in combinations(range(1, SPAN), LETTERS - 1)]
_SPELLED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+\s")


def _fold_table() -> dict[int, str | None]:
    """Every mark goes, stand-ins become letters (only inside words: see ``folded``)."""
    table: dict[int, str | None] = {c: None for c in range(0x250) if not chr(c).isalnum()}
    return table | {ord(a): b for a, b in STAND_INS.items()}


_FOLD = _fold_table()


def folded(word: str) -> str:
    """Lower-case word with stand-ins read as letters and marks dropped; marks at its ends go first."""
    return START + word.strip(".,;:!?\"'()[]{}«»„“”…-").translate(_FOLD)


def windows_of(word: str) -> list[str]:
    """The word, or overlapping windows of a long one."""
    if len(word) <= WINDOW:
        return [word]
    return [word[i: i + WINDOW] for i in range(0, len(word) - STRIDE, STRIDE)]


def letter_codes(words: list[str]) -> np.ndarray:
    """(words, WINDOW) letter codes 1..31; 0 after the end."""
    chars = np.array(words, f"U{WINDOW}").view(np.uint32).reshape(len(words), WINDOW) if words else np.zeros((0, WINDOW), np.uint32)
    plain = (chars >= 97) & (chars < 123)
    return np.where(plain, chars - 96, np.where(chars == 0, 0, np.where(chars == ord(START), 27, 28 + chars % 4))).astype(np.int32)


def _occurrences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(subsequence number, is one, weight) per gap pattern, for all words and starts."""
    wide = np.pad(codes, ((0, 0), (0, SPAN)))
    width = codes.shape[1]
    for gaps in GAPS:
        parts = [wide[:, g: g + width] for g in gaps]
        number = parts[0]
        for p in parts[1:]:
            number = number * CODES + p
        yield number, parts[-1] > 0, DECAY ** (gaps[-1] + 1)


def _norm(codes: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a word's occurrences (1 where it has none)."""
    length = (codes > 0).sum(axis=1)
    total = sum(np.maximum(0, length - g[-1]) * DECAY ** (2 * (g[-1] + 1)) for g in GAPS)
    return np.sqrt(np.where(total > 0, total, 1.0))


def _in_groups(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and letter codes of words, some thousands of like length at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for a in range(0, len(order), 8192):
        rows = order[a: a + 8192]
        yield rows, letter_codes([words[i] for i in rows])[:, : max(LETTERS, len(words[rows[-1]]))]


def weighted_sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of weight * weights[subsequence] over each word's occurrences, by its norm."""
    out = np.zeros(len(words))
    for rows, codes in _in_groups(words):
        got = sum(w * np.where(there, weights[number], 0).sum(axis=1) for number, there, w in _occurrences(codes))
        out[rows] = got / _norm(codes)
    return out


class Landmarks:
    """The subsequences of the landmarks, with their normed weights."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = letter_codes(words)
        norm = _norm(codes)
        parts = [(number[r, c], r, w / norm[r]) for number, there, w in _occurrences(codes) for r, c in [np.nonzero(there)]]
        number, owner, weight = (np.concatenate(x) for x in zip(*parts))
        self.numbers, row = np.unique(number, return_inverse=True)
        self.table = np.zeros((len(self.numbers) + 1, len(words)))  # the last row: any other subsequence
        np.add.at(self.table, (row, owner), weight)
        self.row = np.full(CODES ** LETTERS, len(self.numbers), np.int32)
        self.row[self.numbers] = np.arange(len(self.numbers))

    def kernel(self, words: list[str]) -> np.ndarray:
        """k(word, landmark) of all words and landmarks."""
        out = np.zeros((len(words), len(self.words)))
        for rows, codes in _in_groups(words):
            got = np.zeros((len(rows), len(self.words)))
            for number, there, w in _occurrences(codes):
                row = self.row[number]
                r, c = np.nonzero(there & (row < len(self.numbers)))
                np.add.at(got, r, w * self.table[row[r, c]])
            out[rows] = got / _norm(codes)[:, None]
        return out

    def likeness(self, words: list[str], strength: np.ndarray) -> np.ndarray:
        """The largest kernel value times the landmark's strength, without holding all kernel values."""
        return np.concatenate([(self.kernel(words[i: i + 8192]) * strength).max(axis=1) for i in range(0, len(words), 8192)] or [np.zeros(0)])

    def weights(self, combination: np.ndarray) -> np.ndarray:
        """One weight per subsequence for a linear combination of the landmarks' kernel values."""
        out = np.zeros(CODES ** LETTERS, np.float32)
        out[self.numbers] = (self.table @ combination)[:-1]
        return out


# ------------------------------------------------------------------- training

def sentence_words(text: str) -> list[list[str]]:
    """Windows of the folded words of every sentence, words of three letters and more."""
    out = []
    for sentence in _SENTENCE.split(text):
        words = text_words(sentence)
        if words:
            out.append(words)
    return out


def text_words(text: str) -> list[str]:
    low = text.lower()
    raw = low.split() + [m.replace(" ", "") for m in _SPELLED.findall(low)]
    return [x for w in dict.fromkeys(map(folded, raw)) if len(w) > 3 for x in windows_of(w)]


def grams_of(word: str) -> tuple[str, ...]:
    """A folded word and its 4- to 5-letter substrings, longer ones only from its start."""
    found = {word[i: i + n] for n in (4, 5) for i in range(len(word) - n + 1)} | {word[:n] for n in (6, 7) if len(word) > n}
    return (*found, word) if LETTERS < len(word) <= WINDOW else tuple(found)


def landmark_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic texts, clean texts) of every word and its substrings."""
    schema = pa.schema([("gram", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            texts, ys = column(batch, "text"), column(batch, "y")
            for part in slices(texts, GRAM_LETTERS):  # what a part's grams take is bounded by its letters, not its texts
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                known: dict[str, tuple[str, ...]] = {}
                for text, y in zip(texts[part], ys[part]):
                    found: set[str] = set()
                    for word in set(text.lower().split()):
                        if word not in known:
                            known[word] = grams_of(folded(word))
                        found.update(known[word])
                    counts[y].update(found)
                grams = list(counts[1].keys() | counts[0].keys())
                for at in range(0, len(grams), 50_000):
                    some = grams[at: at + 50_000]
                    yield record(schema, some, [counts[1][g] for g in some], [counts[0][g] for g in some])

    return labelled.select("text", "y").mapInArrow(run, "gram string, pos long, neg long").groupBy("gram").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def pick_landmarks(ranked: list[str], n: int) -> list[str]:
    """The first of ``ranked``, leaving out those much like an earlier one (some at a time, so memory stays small)."""
    chosen: list[str] = []
    for at in range(0, len(ranked), 64):
        part = ranked[at: at + 64]
        before = Landmarks(chosen).kernel(part).max(axis=1) if chosen else np.zeros(len(part))
        among, taken = Landmarks(part).kernel(part), []
        for i in range(len(part)):
            if len(chosen) < n and before[i] <= 0.7 and (not taken or among[i, taken].max() <= 0.7):
                taken.append(i)
                chosen.append(part[i])
        if len(chosen) == n:
            break
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss and balanced classes by Newton steps; last weight: bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    each = np.where(y > 0, cost / max(1, (y > 0).sum()), cost / max(1, (y <= 0).sum())) * len(y) / 2
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        live = sign * (x @ w) < 1
        xa, ca = x[live], each[live]
        grad = ridge * w + 2 * xa.T @ (ca * (xa @ w - sign[live]))
        hess = np.diag(ridge) + 2 * (xa.T * ca) @ xa
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of P(toxic | f), with targets drawn in a little (Platt)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([f, np.ones((len(f), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 1e-2 * w
        hess = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_curves(tops: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two logistic curves: over the largest value alone, and over all TOP of them."""
    one, every = fit_logistic(tops[:, :1], y), fit_logistic(tops, y)
    return np.array([[one[0], *[0.0] * (TOP - 1), one[1]], every])


def spoilt(word: str) -> list[str]:
    """The word with a letter pushed in at two places, as such words are disguised."""
    if len(word) < 5 or len(word) >= WINDOW:
        return []
    pick = sum(map(ord, word))
    return [word[:i] + chr(97 + (pick + 7 * i) % 26) + word[i:] for i in {2 + pick % (len(word) - 3), 2 + (pick // 7) % (len(word) - 3)}]


@dataclass
class Model:
    """Decision value of a word: weighted_sums(word, weights) + bias, no less than ``bias``;
    score of a text: the higher of two logistic curves of its TOP largest values over distinct words."""

    weights: np.ndarray
    bias: float
    curves: np.ndarray

    def score(self, decisions: np.ndarray) -> np.ndarray:
        lines = decisions @ self.curves[:, :-1].T + self.curves[:, -1]
        return (1 / (1 + np.exp(-np.clip(lines, -30, 30)))).max(axis=1)


def no_model() -> Model:
    return Model(np.zeros(CODES ** LETTERS, np.float32), 0.0, np.array([[0.0] * TOP + [-1000.0]] * 2))


def train(labelled: DataFrame, max_texts: int = 6000, n_landmarks: int = 160, rounds: int = 4) -> Model:
    """Fit on ``labelled`` (text, y, order): landmarks by counts over all rows, the SVM on at most ``max_texts``
    texts (half of them toxic at most), fewer where FIT_LETTERS would be passed, taken in the order of ``order``."""
    counts = landmark_counts(labelled)
    n1, n0 = (labelled.where(F.col("y") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return no_model()
    # likelihood ratio (G) of a substring's share of the toxic texts against its share of all
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    rate, n = (pos + neg) / F.lit(float(n0 + n1)), {1: F.lit(float(n1)), 0: F.lit(float(n0))}
    g = (F.when(pos > 0, pos * F.log(pos / (n[1] * rate))).otherwise(0.0)
         + F.when(neg > 0, neg * F.log(neg / (n[0] * rate))).otherwise(0.0)
         + F.when(pos < n[1], (n[1] - pos) * F.log((n[1] - pos) / (n[1] * (1 - rate)))).otherwise(0.0)
         + F.when(neg < n[0], (n[0] - neg) * F.log((n[0] - neg) / (n[0] * (1 - rate)))).otherwise(0.0))
    top = (counts.where((pos >= 2) & (pos * n[0] > 3 * neg * n[1])).withColumn("g", F.round(g, 6))
           .orderBy(F.col("g").desc(), F.length("gram").desc(), "gram").limit(20 * n_landmarks))
    usual = counts.where(neg > 0).orderBy(F.col("neg").desc(), "gram").limit(n_landmarks)
    strength = {r.gram: r.g for r in top.collect()}
    landmarks = pick_landmarks(list(strength), n_landmarks)
    if not landmarks:
        return no_model()
    # common substrings beside the telling ones, so that the SVM can hold them against a word
    landmarks += [g for g in pick_landmarks([r.gram for r in usual.collect()], n_landmarks // 4) if g not in landmarks]
    letters = labelled.agg(F.avg(F.length("text"))).first()[0] or 0
    each = int(min(max_texts, max(FIT_LETTERS / max(letters, 1), 200))) // 2  # fewer of them where texts are long
    taken = [labelled.where(F.col("y") == y).orderBy("order", "text").limit(each).select("text", "y") for y in (1, 0)]
    marks = Landmarks(landmarks)
    kernel = marks.kernel(landmarks)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T  # K_mm^(-1/2)
    at: dict[str, int] = {}
    numbered = [([np.array([at.setdefault(w, len(at)) for w in s], np.int32) for s in sentence_words(r.text)], r.y)
                for r in taken[0].unionAll(taken[1]).toLocalIterator()]
    words = list(at)
    telling = np.sqrt(np.array([strength.get(g, 0.0) for g in landmarks]))
    value, bias, weights = marks.likeness(words, telling), 0.0, None  # at first: likeness to the most telling landmarks
    for _ in range(rounds):
        witness, labels = [], []
        for ss, y in numbered:
            worst = sorted((int(s[np.argmax(value[s])]) for s in ss), key=lambda i: (-value[i], i))
            keep = list(dict.fromkeys(worst))[:4]
            if y:  # the worst word, and others nearly as bad
                keep = [i for i in keep if value[i] >= min(value[keep[0]], max(0.5 * value[keep[0]], 0.0))]
            witness += keep
            labels += [y] * len(keep)
        some, row = np.unique(np.array(witness), return_inverse=True)
        x, y_all = (marks.kernel([words[i] for i in some]) @ root)[row], labels
        often = Counter(i for i, y in zip(witness, labels) if y)
        more = [v for i in sorted(often) if often[i] > 1 for v in spoilt(words[i])]
        if more:
            x, y_all = np.vstack([x, marks.kernel(more) @ root]), labels + [1] * len(more)
        w = fit_svm(x, np.array(y_all))
        weights, bias = marks.weights(root @ w[:-1]), float(w[-1])
        value = weighted_sums(words, weights) + bias
    tops = np.array([top_values(value[np.unique(np.concatenate(ss))] if ss else value[:0], bias) for ss, _ in numbered])
    return Model(weights, bias, fit_curves(tops, np.array([y for _, y in numbered])))


def top_values(values: np.ndarray, bias: float) -> np.ndarray:
    """The TOP largest values, none below ``bias``, filled up with it."""
    best = np.sort(np.append(values, np.full(TOP, bias)))[::-1][:TOP]
    return np.maximum(best, bias)


# -------------------------------------------------------------------- scoring

def decisions(texts: list[str], model: Model) -> np.ndarray:
    """(texts, TOP) largest decision values of each text's distinct words."""
    low = pc.utf8_lower(pa.array(texts, pa.large_string()))
    lists = pc.ascii_split_whitespace(low)
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    value = word_values(distinct, model)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    out = np.full((len(texts), TOP), model.bias)
    live = np.flatnonzero(value[word] > model.bias) if len(word) else np.zeros(0, np.int64)
    pair = np.unique(text[live] * (len(distinct) + 1) + word[live])
    t, w = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
    order = np.lexsort((-value[w], t)) if len(t) else np.zeros(0, np.int64)
    t, w = t[order], w[order]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    best = rank < TOP
    out[t[best], rank[best]] = value[w[best]]
    spelled = pc.match_substring_regex(low, pattern=r"(^|\s)(\S ){3,}\S(\s|$)").to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(spelled).tolist():
        more = [m.replace(" ", "") for m in dict.fromkeys(_SPELLED.findall(low[i].as_py()))]
        out[i] = top_values(np.append(out[i], word_values(more, model)), model.bias)
    return out


def word_values(words: list[str], model: Model) -> np.ndarray:
    """Decision value of each raw word (the largest of its windows)."""
    parts, owner = [], []
    for i, w in enumerate(words):
        f = folded(w)
        if len(f) > 3:
            for x in windows_of(f):
                parts.append(x)
                owner.append(i)
    out = np.full(len(words), model.bias)
    if parts:
        np.maximum.at(out, np.array(owner), weighted_sums(parts, model.weights) + model.bias)
    return out


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_score``."""
    sent = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in batches:
            texts = [t or "" for t in column(batch, text_col)]
            score = model.score(decisions(texts, model)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, docs.withColumn("_score", F.lit(0.0)).schema)


def training_rows(docs: DataFrame, labels: DataFrame, held_out=None, max_labels: int = MAX_LABELS) -> DataFrame:
    """(text, y, order) of at most ``max_labels`` labelled texts, a third of them toxic at most, chosen by a
    hash of the id.  So few ids are safe to broadcast, and the texts stay where they are."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y")))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.withColumn("order", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("y") == y).orderBy("order", "doc_id").limit(n) for y, n in ((1, max_labels // 3), (0, max_labels - max_labels // 3))]
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    return rows.select("text", "y", "order")


def held_out_fold(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 modulo 3 (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from the labelled texts outside the held-out fold."""
    return train(materialize(training_rows(docs, labels, held_out_fold())), **options)




def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 from ``threshold`` on)."""
    model = toxicity_model(docs, labels)
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out_fold().alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    docs, restored = shielded(docs, "doc_id", "text")
    return restored(score_texts(docs, toxicity_model(docs, labels)).where(F.col("_score") < threshold))
