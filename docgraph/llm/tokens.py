"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both the normalizer and the pre-tokenizer of the vocabulary work on either side of a blank or a line feed alone, so the ids
of a text are those of its words one after another. For words of Latin-1 letters with ASCII marks other than an apostrophe
after them it is known beforehand what normalizer and pre-tokenizer make of them: the letters and the marks are apart, and
the library's model gets the letters, in lower case, at once. Half of the new words are letters met before, with other marks or
capitals, so letters can be remembered by themselves, and the model gets each once. Any other word goes through the whole library.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Words that one worker remembers; beyond, it forgets those seen once.
REMEMBERED = 400_000
#: Letters of words that it remembers for token files; beyond, those not met since as many others are forgotten.
LETTERS = 400_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The vocabulary's alphabet has other characters for these bytes than Latin-1 has.
_BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])} | {32: 32}
_OPEN: dict[tuple[str, int, int], Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, remembered: int = REMEMBERED, letters: int = 0) -> Encoder:
    """One for each path and worker, that remembers so many words and letters."""
    key = path, remembered, letters
    if key not in _OPEN:
        _OPEN[key] = Encoder(*key)
    return _OPEN[key]


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED, letters: int = 0):
        self.remembered, self.most_letters = remembered, letters
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.marks: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}  # ids as unsigned 32-bit integers, as everywhere
        self.older: dict[str, bytes] = {}
        self.forget()
        probe = ["Straße,", "ÀÉàé.", "the", "Ðñ", "word.", "xyzzyx", "A,!", "Éa&&&", "x<|", "b_-_"]
        self.plain = [self._whole(w) for w in probe] == self._by_letters(probe)

    def forget(self) -> None:
        self.known = defaultdict(count().__next__)  # numbers of words, in their order
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.count, self.seen = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, k: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of the words from number k on."""
        n = len(counts)
        while k + n > len(self.begin):
            self.begin, self.count, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[k : k + n] = self.used + np.cumsum(counts) - counts
        self.count[k : k + n] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _whole(self, word: str) -> bytes:
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def _of_letters(self, text: str) -> bytes:
        """The ids of letters in lower case that are not among those met last."""
        ids = self.older.get(text)
        if ids is None:
            plain = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)
            ids = array("I", [t.id for t in self.tokenize(plain)]).tobytes()
        if self.most_letters:
            if len(self.letters) >= self.most_letters:
                self.older, self.letters = self.letters, {}
            self.letters[text] = ids
        return ids

    def _of_marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 20_000:
                self.marks.clear()
            self.marks[marks] = self._whole(marks)
        return self.marks[marks]

    def _by_letters(self, words: list[str]) -> list[bytes]:
        out = []
        for word in words:
            core = word if word.isalpha() else word.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or _LETTERS(core)):
                text = core.lower()
                ids = self.letters.get(text)
                if ids is None:
                    ids = self._of_letters(text)
                out.append(ids if len(core) == len(word) else ids + self._of_marks(word[len(core) :]))
            else:
                out.append(self._whole(word))
        return out

    def _learn(self, words: list[str]) -> None:
        """The ids of the words that were numbered last."""
        found = self._by_letters(words) if self.plain else [self._whole(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self._add(len(self.known) - len(words), np.frombuffer(b"".join(found), np.uint32), counts)

    def _trim(self) -> None:
        """Keep the words seen more than once, in at most half of the room."""
        n = len(self.known)
        order = np.argsort(-self.seen[:n], kind="stable")[: self.remembered // 2]
        kept = np.sort(order[self.seen[order] > 1])
        words = list(self.known)
        words = [words[k] for k in kept.tolist()]  # the number of a word is its place in known
        lengths = self.count[kept]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(lengths.sum()) + np.repeat(self.begin[kept] - ends + lengths, lengths)]
        self.forget()
        self.known.update(zip(words, range(len(words)), strict=True))
        self.known.default_factory = count(len(words)).__next__
        self._add(0, ids, lengths)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and len + 1 offsets; null is empty."""
        lists = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.remembered:
            self._trim()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        before = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        if len(self.known) > before:
            self._learn([*islice(reversed(self.known), len(self.known) - before)][::-1])
        self.seen[: len(self.known)] += np.bincount(index, minlength=len(self.known))
        lengths = self.count[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[index] - ends[:-1], lengths)]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


def with_end(ids: np.ndarray, offs: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text."""
    out = np.full(len(ids) + len(offs) - 1, end, ids.dtype)
    own = np.ones(len(out), bool)
    to = offs + np.arange(len(offs))
    own[to[1:] - 1] = False
    out[own] = ids
    return out, to
