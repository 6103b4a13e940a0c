"""Texts to token ids, with each distinct word encoded once per worker.

For the two known layouts of byte-level BPE files, text of common Latin characters is
split into words by Arrow string kernels (or, where a text needs the layout's full
pattern, by that pattern), the words are dictionary-encoded, and only words that this
worker hasn't met go through the tokenizer's merges.  Any other text or layout goes to the
tokenizer whole, as does any text that names an added token of the file ("<|endoftext|>"), so
the ids are always those of the tokenizers library.
"""

from __future__ import annotations

import array
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ragtide.llm.common import column, worker_cache

WORDS_KEPT = 700_000  # distinct words a worker remembers before it starts afresh
CALL_BYTES = 4 << 20  # texts encoded at once
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœ"
_DIGIT = "0-9²³¹¼-¾"
_OTHER = rf"[^\s\x1f{_LETTER}{_DIGIT}]"
# characters whose classes and cases all libraries agree on
_PLAIN = re.compile("[\t\n\r -~¡-ÿŒœ‐-‧]*")
_PATTERN = {
    "byte": re.compile(rf"{_CUTS}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?{_OTHER}+|\s+(?!\S)|\s+"),
    "lower": re.compile(rf"{_CUTS}|[{_LETTER}]+|[{_DIGIT}]|{_OTHER}+"),
}
# texts that the kernels can't split: contractions, and white space in runs (bytes keep it)
_HARD = {"byte": re.compile(r"'|\s\s"), "lower": re.compile("'")}


def _layout(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    if (kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == _CUTS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1].get("use_regex")):
        return "lower"
    return "whole"


def _added(path: str) -> re.Pattern | None:
    """Finds texts that may name an added token; one that is looked for in normalized text is found in any case."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    names = [f"(?i:{re.escape(t['content'])})" if t.get("normalized") else re.escape(t["content"]) for t in tokens if t["content"]]
    return re.compile("|".join(names)) if names else None


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one letter: printable bytes as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.layout = _layout(path)
        self.added = _added(path)
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.start, self.length, self.ids = array.array("q", [0]), array.array("q", [0]), array.array("I")

    def _learn(self, words: list[str]) -> None:
        for word in words:
            self.place[word] = len(self.start)
            got = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
            self.start.append(len(self.ids))
            self.length.append(len(got))
            self.ids.extend(got)

    def _words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts in order, and where each text's words end."""
        hard = [bool(_HARD[self.layout].search(t)) for t in texts]
        easy = pa.array([t for t, h in zip(texts, hard) if not h], pa.large_string())
        if self.layout == "lower":
            spaced = pc.replace_substring_regex(pc.utf8_lower(easy), pattern=rf"({_OTHER}+|[{_DIGIT}])", replacement=" \\1 ")
            lists = pc.ascii_split_whitespace(spaced)
        else:
            marked = pc.replace_substring_regex(easy, pattern=rf"( ?[{_DIGIT}]+| ?{_OTHER}+|[\n\r\t])", replacement="\x1f\\1\x1f")
            lists = pc.split_pattern(pc.replace_substring(marked, pattern=" ", replacement="\x1f "), "\x1f")
        words, n_easy = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        if not any(hard):
            return words, np.cumsum(n_easy)
        parts, ends, upto, k, at = [], [], 0, 0, 0
        for t, h in zip(texts, hard):
            if h:
                found = _PATTERN[self.layout].findall(t.lower() if self.layout == "lower" else t)
                parts.append(pa.array(found, pa.large_string()))
                upto += len(found)
            else:
                parts.append(words.slice(at, n_easy[k]))
                at, upto, k = at + int(n_easy[k]), upto + int(n_easy[k]), k + 1
            ends.append(upto)
        return pa.concat_arrays([p.cast(pa.large_string()) for p in parts]), np.array(ends, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        plain = [self.layout != "whole" and bool(_PLAIN.fullmatch(t)) and not (self.added and self.added.search(t)) for t in texts]
        if all(plain):
            return self._encode_plain(texts)
        flat, n = self._encode_plain([t for t, p in zip(texts, plain) if p]) if any(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        known = iter(np.split(flat, np.cumsum(n)[:-1])) if len(n) else iter(())
        parts = [next(known) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                 for t, p in zip(texts, plain)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words, ends = self._words(texts)
        coded = words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) > WORDS_KEPT:
            self._forget()
        at = [self.place.get(w, -1) for w in distinct]
        self._learn([w for w, a in zip(distinct, at) if a < 0])
        at = np.array([self.place[w] if a < 0 else a for w, a in zip(distinct, at)], np.int64)
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        start, length = np.frombuffer(self.start, np.int64)[at], np.frombuffer(self.length, np.int64)[at]
        upto = np.concatenate([[0], np.cumsum(length)])
        pick = np.repeat(start - upto[:-1], length) + np.arange(upto[-1])
        flat = np.frombuffer(self.ids, np.uint32)[pick] if len(pick) else np.zeros(0, np.uint32)
        return flat, np.diff(upto[ends], prepend=0)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    kept = worker_cache("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encoded_rows(batches, enc: Encoder, names: tuple[str, ...]):
    """(values of the named columns, ids) of every row, encoding about CALL_BYTES of text at a time;
    the last name is the text's."""
    rows, texts, size = [], [], 0

    def done():
        flat, n = enc.encode(texts)
        at = np.cumsum(n) - n
        for row, a, k in zip(rows, at.tolist(), n.tolist()):
            yield row, flat[a:a + k]

    for batch in batches:
        for *row, text in zip(*(column(batch, c) for c in names)):
            rows.append(row)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= CALL_BYTES:
                yield from done()
                rows, texts, size = [], [], 0
    if rows:
        yield from done()
