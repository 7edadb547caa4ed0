"""Exact token ids of a byte-level BPE file from the tokenizers library, remembered by space-led chunk.

A byte-level BPE splits text before it merges. A space between two other non-space characters always starts a new
pre-token, so a text falls into chunks (one such space and what follows up to the next one) that are encoded on their own,
whatever surrounds them. Other white space stays inside its chunk. Chunks that are not remembered are encoded as one text, out
of which each is cut at the ids that start with a space.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER_PATH = public_tokenizers.path("byte_bpe_50k.json")

# A task has one core: Spark spreads the work, not the library's threads.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BORDER = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]|  | \n|\n ")

#: Longer chunks are encoded each time they occur.
LONGEST_KEPT = 100
#: A run of these behind a word of ASCII letters is a pre-token of its own.
MARKS = ",.;:!?"
MOST_MARKS = 1_000
#: Chunks looked up between two looks at the memory's size.
CHUNKS_AT_ONCE = 10_000


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encode_all(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of texts, without begin, end or added tokens."""
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def encode_whole(path: str, text: str) -> list[int]:
    return encode_all(path, [text])[0]


def chunks(text: str) -> list[str]:
    """The text cut at the spaces where a pre-token is sure to start; these spaces are left out."""
    return _BORDER.split(text) if _OTHER_SPACE.search(text) else text.split(" ")


@lru_cache(maxsize=4)
def space_led(path: str) -> np.ndarray:
    """Whether an id's piece starts with a plain space."""
    vocabulary = load(path).get_vocab()
    space = next(letter for letter, byte in byte_letters().items() if byte == ord(" "))
    led = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
    led[[i for piece, i in vocabulary.items() if piece.startswith(space)]] = True
    return led


def chunk_ids(path: str, parts: list[str]) -> dict:
    """Ids of space-led chunks, by the chunk without its space.

    A chunk that no space is in and no white space is around has one space-led id, its first, also next to others like it.
    """
    plain = [p for p in parts if p and " " not in p and not p[0].isspace() and not p[-1].isspace()]
    others = list({*parts}.difference(plain)) if len(plain) < len(parts) else []
    ids = np.array(encode_whole(path, "".join([" " + p for p in plain])), "<u4")
    starts = np.flatnonzero(space_led(path)[ids]).tolist()
    found = {p: ids[a:b] for p, a, b in zip(plain, starts, [*starts[1:], len(ids)], strict=True)} if plain else {}
    return found | dict(zip(others, encode_all(path, [" " + p for p in others])))


class Remembered(dict):
    """What ``make`` gives for a space-led chunk, by the chunk without its space.

    Starts over from ``first`` when full, but for what is asked again of what it held until then.
    """

    def __init__(self, path: str, make, first=None, most: int = 500_000):
        super().__init__(first or {})
        self.path, self.make, self.first, self.most = path, make, first or {}, most
        self.older, self.asked, self.marks = {}, [], {}

    def __missing__(self, part: str):
        self.asked.append(part)

    def values_of(self, parts: list[str]) -> list:
        """The chunks' values in order."""
        out = []
        for start in range(0, len(parts), CHUNKS_AT_ONCE):
            some = parts[start : start + CHUNKS_AT_ONCE]
            if len(self) >= self.most + len(self.first):
                self.older = dict(self)
                self.clear()
                self.update(self.first)
            self.asked = []
            values = list(map(self.__getitem__, some))  # each looked up once: most of the time goes there
            if self.asked:
                new = dict.fromkeys(self.asked)
                self._learn(new)
                values = [self[p] if v is None else v for p, v in zip(some, values)]
                for part in new:
                    if len(part) > LONGEST_KEPT:
                        del self[part]
            out += values
        return out

    def _learn(self, new: dict) -> None:
        """Take up chunks: what was held before, letters with known marks behind them, and the rest from the library."""
        again = {p: self.older[p] for p in new if p in self.older}
        self.update(again)
        rest = [p for p in new if p not in again] if again else new
        words = {p: word for p in rest if (word := p.rstrip(MARKS)) != p and len(p) <= LONGEST_KEPT and word.isascii() and word.isalpha()}
        self.update((w, self.older[w]) for w in words.values() if w in self.older)
        unknown = dict.fromkeys(p for p in (words.get(p, p) for p in rest) if p not in self)
        self.update((p, self.make(ids)) for p, ids in chunk_ids(self.path, list(unknown)).items())
        for p, word in words.items():
            self[p] = self[word] + self._marks(p[len(word) :])

    def _marks(self, marks: str):
        if marks not in self.marks:
            if len(self.marks) >= MOST_MARKS:
                self.marks.clear()
            self.marks[marks] = self.make(encode_whole(self.path, marks))
        return self.marks[marks]


def as_words(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def worker_ids(path: str) -> Remembered:
    """The id memory of this worker process."""
    return Remembered(path, as_words)


def text_ids(path: str, text: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers, out of the worker's memory where chunks repeat."""
    head, *rest = chunks(text)
    return as_words(encode_whole(path, head)) + b"".join(worker_ids(path).values_of(rest))
