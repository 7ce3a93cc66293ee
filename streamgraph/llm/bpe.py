"""Byte-level BPE ids as the tokenizers library gives them.

Added special strings are split off first and become their ids, as the library does by
default. What is left is cut into chunks of bounded size at safe boundaries: a single
space between two characters that are not white space always ends a pre-token. Chunks of
characters below U+0250 are encoded by tiktoken from the same vocabulary's ranks (several
times faster; a test holds all those characters against the library); all others by the
library itself.

A batch of texts is cut at every safe boundary, and each distinct unit between two of them
is encoded once.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np

from . import words

#: Longer texts are encoded in chunks of at least so many characters, each up to the next safe boundary.
CHUNK_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_EXOTIC = re.compile("[ɐ-\U0010ffff]")
#: The first byte of a character of U+0250 or above is this at least.
_EXOTIC_BYTE = 0xC9
#: A batch of more bytes is encoded text by text, so that its tables of units stay small.
BATCH_BYTES = 1 << 21


def _white(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of all white space and control characters, and of few other characters: U+1680 to U+16BF, U+1800 to U+183F, U+2000 to U+207F, U+3000 to U+303F."""
    white = data <= 0x20
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        pair = data[lead].astype(np.uint16) << 8 | data[lead + 1]
        two, three = lead[np.isin(pair, (0xC285, 0xC2A0))], lead[np.isin(pair, (0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380))]
        for at in (two, two + 1, three, three + 1, three + 2):
            white[at] = True
    return white


class Texts:
    """An encoder of single texts."""

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[offsets[i]:offsets[i + 1]] (UTF-8) one after the other, and where each text's begin and end."""
        found = [self.ids(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])


class Bpe(Texts):
    """``ids(text)``: the ids of a whole text as a numpy array; ``count(text)``: how many; ``batch``: the ids of many texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = {x["content"]: x["id"] for x in added}
        plain = not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word"))
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain
        self.fast = self._ranked(path) if self.cuts else None
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.units = self.cuts and pre.get("use_regex", True) and not any(" " in x for x in self.special)
        vocab = self.library.get_vocab() if self.units else {"": 0}
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: a byte-level token has a character for each
        self.size[list(vocab.values())] = [len(x) for x in vocab]

    @staticmethod
    def _ranked(path: str):
        try:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        except (ImportError, FileNotFoundError):  # then the library encodes everything
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chunks(self, text: str) -> Iterator[str | int]:
        """The text in chunks that are encoded independently, and the ids of special strings between them."""
        at = 0
        if self.cuts and self._special and any(s in text for s in self.special):
            for m in self._special.finditer(text):
                yield from self._cut(text[at : m.start()])
                yield self.special[m[0]]
                at = m.end()
        yield from self._cut(text[at:])

    def _cut(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > CHUNK_CHARS and (m := _SAFE.search(text, at + CHUNK_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:]

    def _encode(self, chunk: str | int) -> np.ndarray:
        if isinstance(chunk, int):
            return np.array([chunk], "<u4")
        if self.fast is not None and (chunk.isascii() or not _EXOTIC.search(chunk)):
            return np.asarray(self.fast.encode_to_numpy(chunk, disallowed_special=()), "<u4")
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        found = [self._encode(x) for x in self.chunks(text)]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, "<u4"), *found])

    def count(self, text: str) -> int:
        return sum(len(self._encode(x)) for x in self.chunks(text))

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.units or not len(data) or len(data) > BATCH_BYTES:
            return super().batch(data, offsets)
        white, body, full = _white(data), data.tobytes(), np.flatnonzero(np.diff(offsets))
        cut = data == 0x20  # a safe boundary: a single space between two characters of one text that are not white space
        cut[1:] &= ~white[:-1]
        cut[:-1] &= ~white[1:]
        cut[offsets[1:][full] - 1] = False
        strings = [x for x in map(str.encode, self.special) if x in body]
        special = [i for i in full.tolist() if any(x in body[offsets[i] : offsets[i + 1]] for x in strings)] if strings else []
        for i in special:  # such a text is one unit
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][full]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        _, at, kind = np.unique(words.hashes(data, start, end), return_index=True, return_inverse=True)
        if not words.equal(data, start, end, at[kind]):
            return super().batch(data, offsets)
        begin, stop = start[at], end[at]
        joins = (data[begin] == 0x20) & (stop - begin > 1) & ~white[np.minimum(begin + 1, len(data) - 1)] & ~white[stop - 1]
        joins &= ~np.isin(begin, offsets[special])
        flat, first, n = self._each(data, begin, stop, joins)
        first, n = first[kind], n[kind]
        total = np.append(0, np.cumsum(n))
        return flat[np.arange(total[-1]) + np.repeat(first - total[:-1], n)], total[np.searchsorted(start, offsets)]

    def _each(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of units, and where each unit's begin and how many they are.

        Units that ``joins`` marks begin with a safe boundary and end before one: they are encoded in one string, others each by itself.
        """
        high = data >= _EXOTIC_BYTE
        exotic = np.diff(np.append(0, np.cumsum(high, dtype=np.int32))[[begin, stop]], axis=0)[0] > 0 if high.any() else np.zeros(len(begin), bool)
        alone, flat, at = np.flatnonzero(~joins).tolist(), [], 0
        first, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for some in (np.flatnonzero(joins & ~exotic), np.flatnonzero(joins & exotic)):
            if not len(some):
                continue
            size = stop[some] - begin[some]
            ends = np.cumsum(size)
            ids = self.ids(data[np.arange(ends[-1]) + np.repeat(begin[some] - ends + size, size)].tobytes().decode())
            reached = np.cumsum(self.size[ids])
            last = np.searchsorted(reached, ends)
            if last[-1] == len(ids) - 1 and np.array_equal(reached[last], ends):
                n[some] = np.diff(last, prepend=-1)
                first[some] = at + last + 1 - n[some]
                flat, at = [*flat, ids], at + len(ids)
            else:  # an id reaches from unit to unit, or the bytes of one are not known
                alone += some.tolist()
        for i in alone:
            ids = self.ids(data[begin[i] : stop[i]].tobytes().decode())
            first[i], n[i], at = at, len(ids), at + len(ids)
            flat.append(ids)
        return np.concatenate(flat), first, n


class Pieces(Texts):
    """A sentencepiece model: ``count(text)`` without begin or end."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, num_threads=1), "<u4") if text else np.zeros(0, "<u4")

    def count(self, text: str) -> int:
        return len(self.ids(text))


_open: dict[str, Bpe | Pieces] = {}


def opened(path: str) -> Bpe | Pieces:
    """One of a file and worker process."""
    if path not in _open:
        _open[path] = Pieces(path) if path.endswith(".model") else Bpe(path)
    return _open[path]
