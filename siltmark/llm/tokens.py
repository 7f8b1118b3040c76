"""Fast exact encoding of whole texts with a public tokenizer whose pieces never span ASCII white space.

Texts are split at ``[\\x20\\x09-\\x0D]`` by Arrow, the distinct words of some MB of text are looked up, new ones are
encoded once by the tokenizers library and kept, and texts are put together from kept words by array lookups. That
equals encoding the whole text when the tokenizer drops white space and works on either side of it independently; an
encoder is refused where a probe shows otherwise, and tests hold the two against each other on whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import _shared as S

#: Words that one Python worker keeps; beyond that it starts anew. Bounds memory, not results.
KEPT_WORDS = 700_000
#: Bytes of text that are put together at once.
SLICE_BYTES = 6 << 20
#: Words that the library encodes in one call.
LEARN_WORDS = 2048

#: Byte-level pieces write a byte as its own character where that can be seen, the others as those from 256 on.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: c for b, c in zip(sorted(set(range(256)) - set(SEEN)), count(256), strict=False)}

_ENCODERS: dict[str, Encoder] = {}


class _Lists:
    """Lists of ids by number, one after the other."""

    def __init__(self):
        self.ids, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(lens) > len(self.size):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.size[self.n : self.n + len(lens)] = lens
        self.used, self.n = self.used + len(ids), self.n + len(lens)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists one after the other, and the length of each."""
        lens = self.size[at]
        before = np.cumsum(lens) - lens
        return self.ids[np.arange(int(lens.sum())) + np.repeat(self.start[at] - before, lens)], lens


def _split_pattern(spec: dict) -> str | None:
    """The pattern that cuts lower-cased words into pieces, of a tokenizer that works that way; else none."""
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return None
    cut, level = steps
    if cut["behavior"] != "Removed" or not cut["invert"] or level["use_regex"] or level["add_prefix_space"]:
        return None
    return cut["pattern"].get("Regex")


class Encoder:
    """A tokenizer and the ids of the words it has met.

    Where the tokenizer lower-cases, splits by a pattern and maps bytes, as its file says, words of plain characters are
    lower-cased and split here and only their distinct pieces go to the library; a character is plain if the library is
    seen to treat it so. Other words, and all words of other tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.probe(path)
        self.reset()
        self.reset_pieces()
        self.plain = False
        spec = json.loads(self.tokenizer.to_str())
        if pattern := _split_pattern(spec):
            self.pattern = regex.compile(rf"\n|{pattern}")
            self.model = self.tokenizer.model
            chars = [chr(k) for k in range(0x21, 0x250) if not chr(k).isspace()]
            good = [c for c, x, y in zip(chars, self._by_library([f"a{c}b" for c in chars]), self._by_pieces([f"a{c}b" for c in chars]), strict=True) if np.array_equal(x, y)]
            marks = "".join(f"|{regex.escape(x['content'])}" for x in spec["added_tokens"])
            self.other = regex.compile(f"[^\\n{regex.escape(''.join(good), special_only=False)}]{marks}")
            self.plain = True

    def probe(self, path: str) -> None:
        """Refuses a tokenizer whose ids of a text are not those of its words."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        words = ("Word", "don't", "x1,y2.", "Ünï-code", "(a)", "12.5%", "日本語", "é")
        apart = [i for w in words for i in ids(w)]
        for space in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n\n ", "\r\n"):
            if ids(space.join(words)) != apart or ids(space + words[0] + space) != ids(words[0]):
                raise ValueError(f"{path} does not encode words apart from the white space around them: its ids cannot be put together from words")

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.words = _Lists()

    def reset_pieces(self) -> None:
        self.piece_at: dict[str, int] = {"\n": 0}
        self.kept_pieces = _Lists()
        self.kept_pieces.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), LEARN_WORDS):
            part = words[k : k + LEARN_WORDS]
            if self.plain:
                joined = "\n".join(part)
                whole = set()
                if self.other.search(joined):
                    whole = {w for w in part if self.other.search(w)}
                plain = [w for w in part if w not in whole] if whole else part
                self._keep(plain, *self._piecewise(plain))
                part = [w for w in part if w in whole]
            self._keep(part, *self._whole(part))

    def _keep(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.at)
        self.words.add(ids, lens)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call with the words given apart; word_ids tells which word an id is of."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def _piecewise(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.piece_at) > KEPT_WORDS:
            self.reset_pieces()
        pieces = self.pattern.findall("\n".join(words).lower())
        new = list({x for x in pieces if x not in self.piece_at})
        if new:
            found = [[t.id for t in self.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_CHARS))] for x in new]
            n = len(self.piece_at)
            self.kept_pieces.add(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
            self.piece_at.update(zip(new, range(n, n + len(new)), strict=True))
        at = np.fromiter(map(self.piece_at.__getitem__, pieces), np.int64, len(pieces))
        ids, lens = self.kept_pieces.take(at)
        word = np.cumsum(at == 0)  # a line feed parts two words and has no ids
        return ids, np.bincount(word, lens, len(words)).astype(np.int64)

    def _by_library(self, words: list[str]) -> list[np.ndarray]:
        ids, lens = self._whole(words)
        return np.split(ids, np.cumsum(lens)[:-1])

    def _by_pieces(self, words: list[str]) -> list[np.ndarray]:
        ids, lens = self._piecewise(words)
        return np.split(ids, np.cumsum(lens)[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each), of a string array without nulls."""
        if len(self.at) > KEPT_WORDS:
            self.reset()
        split = pc.ascii_split_whitespace(texts)
        ends = np.asarray(split.offsets)
        ends = ends - ends[0]
        kinds = split.flatten().dictionary_encode()
        # no word holds a line feed, and one long string becomes Python's faster than many short ones
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kinds.dictionary)], pa.int32()), kinds.dictionary), "\n")[0].as_py().split("\n") if len(kinds.dictionary) else []
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            found = [words[k] for k in new.tolist()]
            self.learn(found)
            at[new] = np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))
        ids, lens = self.words.take(at[np.asarray(kinds.indices)])
        return ids, np.diff(np.concatenate(([0], np.cumsum(lens)))[ends])


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(path: str, texts: pa.Array):
    """Yields (first row, ids, counts) over an Arrow string column, some MB of text at a time. Null: empty."""
    enc = encoder(path)
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        to = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield first, *enc.encode(texts.slice(first, to - first))
        first = to
    S.release()
