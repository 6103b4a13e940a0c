"""Licence scans: matching statistics against a generalised suffix automaton of licence words.

Texts are streamed word by word through the automaton of all templates and phrases.  At each place it knows the longest
run of words ending there that stands in some template; runs that can't be extended are long matches.  Matches of one
template in the same order in text and template, with bounded gaps, are chained into spans, and a span that covers
enough of its template gives the template's label.  Texts are scanned where they lie: one narrow stage, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.llm.common import received, shipped, small_batches
from ragtide.llm.license_texts import PHRASES, TEMPLATES

SLICE = 1 << 20  # bytes of a text that are split into words at a time
LONG = 3  # words of a match from which it counts (whole templates shorter than that always do)
GAP = 12  # words between two matches of a chain, in the text and in the template
COVERED = 0.7  # share of a template's words that a chain must cover to give its label,
ENOUGH = 25  # or this many words
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words (A-Z only) of UTF-8 text: runs of digits, ASCII letters and anything beyond ASCII."""
    return data.translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton of word sequences; state 0 is the empty run."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        texts = [words_of(t.encode()) for _, t in [*templates, *phrases]]
        if any(len(t) < 2 for t in texts):
            raise ValueError("a template or phrase needs two words at least")
        self.labels = [label for label, _ in templates]
        self.phrases = [label for label, _ in phrases]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.lengths = [len(t) for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.ids[w] for w in t] for t in texts]
        for t in coded:
            last = 0
            for w in t:
                last = self._extend(last, w)
        size = len(self.ids)
        self.pairs = np.zeros((size + 1) * (size + 1), dtype=bool)  # which two words stand side by side in a template
        for t in coded:
            for a, b in zip(t, t[1:]):
                self.pairs[a * (size + 1) + b] = True
        self._places(coded)

    def _extend(self, last: int, w: int) -> int:
        if (to := self.next[last].get(w)) is not None:  # the run is known from another template
            return to if self.length[to] == self.length[last] + 1 else self._split(last, w, to)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, w, to)
        return new

    def _split(self, at: int, w: int, to: int) -> int:
        """The shorter runs of state ``to`` become a state of their own."""
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _places(self, coded: list[list[int]]) -> None:
        """Where each state's runs end: (template, words up to there); and which phrases end with it."""
        ends: list[set] = [set() for _ in self.next]
        named: list[set] = [set() for _ in self.next]
        first = len(self.labels)
        for k, t in enumerate(coded):
            at = 0
            for i, w in enumerate(t):
                at = self.next[at][w]
                ends[at].add((k, i + 1))
            if k >= first:
                named[at].add(k - first)
        order = sorted(range(1, len(self.next)), key=lambda s: self.length[s])
        for s in reversed(order):
            ends[self.link[s]] |= ends[s]
        for s in order:
            named[s] |= named[self.link[s]]
        self.ends = [sorted(e for e in x if e[0] < first) for x in ends]
        self.named = [sorted(x) for x in named]


class Scan:
    """One text: feed it in slices, then read what it holds."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.n_words, self.before, self.state, self.run = 0, len(automaton.ids), 0, 0
        self.places: list[tuple[int, int]] = []  # (phrase, first word)
        self.matches: list[tuple[int, int, int]] = []  # (state, words, end) of runs that can't be extended

    def feed(self, words: list[bytes]) -> None:
        a, size = self.a, len(self.a.ids)
        get = a.ids.get
        ids = np.array([self.before, *[get(w, size) for w in words]], dtype=np.int64)
        linked = np.flatnonzero(a.pairs[ids[:-1] * (size + 1) + ids[1:]])  # only these words extend a run
        if not len(linked) or linked[0] != 0:
            self._end(self.n_words)
        if len(linked):
            cuts = np.flatnonzero(np.diff(linked) != 1) + 1
            for group in np.split(linked, cuts):
                first, end = int(group[0]), int(group[-1]) + 1
                if first or not self.run:
                    self._end(self.n_words + first)
                    self._step(int(ids[first]), self.n_words + first)
                for i in range(first, end):
                    self._step(int(ids[i + 1]), self.n_words + i + 1)
                if end < len(words):
                    self._end(self.n_words + end)
        self.n_words += len(words)
        self.before = int(ids[-1])

    def _step(self, w: int, end: int) -> None:
        """The run ends with word ``w``, ``end`` words into the text."""
        a, state, run = self.a, self.state, self.run
        if w not in a.next[state]:
            self._match(end - 1)
            while state and w not in a.next[state]:
                state = a.link[state]
                run = a.length[state]
            state, run = (a.next[state][w], run + 1) if w in a.next[state] else (0, 0)
        else:
            state, run = a.next[state][w], run + 1
        self.state, self.run = state, run
        for p in a.named[state]:
            words = a.lengths[len(a.labels) + p]
            if words <= run:
                self.places.append((p, end - words))

    def _match(self, end: int) -> None:
        if self.run > 1 and (self.run >= LONG or any(self.a.lengths[k] == self.run for k, _ in self.a.ends[self.state])):
            self.matches.append((self.state, self.run, end))

    def _end(self, end: int) -> None:
        self._match(end)
        self.state, self.run = 0, 0

    def spans(self) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, words covered) of all chains, by place."""
        self._end(self.n_words)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for state, run, end in self.matches:
            for k, at in self.a.ends[state]:
                by.setdefault(k, []).append((end, at, run))
        out = [(k, *c) for k, found in by.items() for c in chains(sorted(found))]
        return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of chains over one template's matches (end in the text, end in the template, words).

    A match follows another if it ends later in both, with at most GAP words between them; of what they overlap only the
    new words count.  The chain that covers most is taken (the earliest of equals), then the rest on both sides of it.
    """
    out, todo = [], [found]
    while todo:
        for part, before in _groups(todo.pop()):
            best, back = [], []
            for (end, at, run), earlier in zip(part, before):
                score, came = run, -1
                for j in earlier:
                    gain = best[j] + min(run, end - part[j][0], at - part[j][1])
                    if gain > score:
                        score, came = gain, j
                best.append(score)
                back.append(came)
            last = i = max(range(len(part)), key=lambda j: (best[j], -j))
            while back[i] >= 0:
                i = back[i]
            first, end = part[i][0] - part[i][2], part[last][0]
            out.append((first, end, best[last]))
            todo += [rest for rest in ([m for m in part if m[0] <= first], [m for m in part if m[0] - m[2] >= end]) if rest]
    return sorted(out)


def _groups(found: list[tuple[int, int, int]]) -> Iterator[tuple[list, list[list[int]]]]:
    """Matches that share words of the text or may follow each other, and for each one those that it may follow."""
    ends, most = [m[0] for m in found], max((m[2] for m in found), default=0)
    before: list[list[int]] = []
    group = list(range(len(found)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, (end, at, run) in enumerate(found):
        before.append([])
        for j in range(bisect_left(ends, end - GAP - most), i):
            e, t, _ = found[j]
            if e < end and t < at and end - run - e <= GAP and at - run - t <= GAP:
                before[i].append(j)
            if e > end - run or before[i][-1:] == [j]:
                group[root(j)] = root(i)
    by: dict[int, list[int]] = {}
    for i in range(len(found)):
        by.setdefault(root(i), []).append(i)
    for members in by.values():
        place = {i: k for k, i in enumerate(members)}
        yield [found[i] for i in members], [[place[j] for j in before[i]] for i in members]


def slices(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, about SLICE bytes at a time, cut between words."""
    at = 0
    while at < len(data):
        cut = _BREAK.search(data, at + SLICE) if at + SLICE < len(data) else None
        end = cut.start() if cut else len(data)
        yield words_of(data[at:end])
        at = end


def scanned(data: bytes | None, automaton: Automaton) -> Scan:
    scan = Scan(automaton)
    for words in slices(data or b""):
        scan.feed(words)
    return scan


def _scans(documents: DataFrame, text: str, doc_id: str, templates, phrases, schema: T.StructType, rows_of) -> DataFrame:
    spark = documents.sparkSession
    small_batches(spark)
    sent = shipped(spark, Automaton(templates, phrases))  # as large as the templates, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = received(sent)
        for batch in batches:
            ids, rows = batch.column(0), []
            picked = []
            for i in range(batch.num_rows):
                for row in rows_of(scanned(batch.column(1)[i].as_py(), automaton)):
                    picked.append(i)
                    rows.append(row)
            if rows:
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(picked)), *cols], names=names)

    to_arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    types, names = [to_arrow[f.dataType] for f in schema.fields], ["doc_id", *schema.names]
    full = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), *schema.fields])
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, full)


def _named(scan: Scan) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, end, covered words, share of the template) of every chain."""
    a = scan.a
    return [(a.labels[k], first, end, covered, covered / a.lengths[k]) for k, first, end, covered in scan.spans()]


def _counts(covered: int, share: float) -> bool:
    return share >= COVERED or covered >= ENOUGH


def license_spans(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, label, first_word, end_word, covered, share): the spans of whole texts that hold a licence template.

    Words count from 0, ``end_word`` is the one after the span.  Null and empty texts have no spans, repeated rows have
    theirs each, other columns are ignored, and an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("label", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "covered")), T.StructField("share", T.DoubleType())])
    return _scans(documents, text, doc_id, templates, phrases, schema, lambda scan: [s for s in _named(scan) if _counts(s[3], s[4])])


def license_report(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row for each document: words, places of the phrases, labels of phrases and of covered templates, score.

    ``labels`` joins the phrases' labels and those of all accepted spans; ``score`` is the largest share of a template that
    one chain covers, 1 where a phrase stands, 0 without any match.  A null text counts as empty (no words, no labels: empty
    strings, null places, score 0); null ids and repeated rows keep a row each; other columns are ignored; an empty table gives no rows.
    """
    longs = ("n_words", "n_base", "first_word", "last_word")
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in longs), T.StructField("base_labels", T.StringType()),
                           T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())])

    def rows_of(scan: Scan) -> list[tuple]:
        spans = _named(scan)
        accepted = [s for s in spans if _counts(s[3], s[4])]
        starts = [start for _, start in scan.places]
        base = {scan.a.phrases[p] for p, _ in scan.places}
        score = 1.0 if base else max((s[4] for s in spans), default=0.0)
        return [(scan.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                 ",".join(sorted(base | {s[0] for s in accepted})), score, len(accepted))]

    return _scans(documents, text, doc_id, templates, phrases, schema, rows_of)
