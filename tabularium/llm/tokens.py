"""Token ids of whole texts by a tokenizers file, word by word.

The tokenizer's normaliser and splitter never reach across ASCII white space,
so a text's ids are those of its white-space separated words in order.  Marks
at the end of a word are set apart and words of ASCII are lower-cased, for
whole slices at once: fewer different words, the same ids.  Each different word
of a slice is looked up once; a task keeps the ids of words it has met (beyond
``_MOST_WORDS`` it starts anew) and asks the library for new ones: its model
for those of letters alone, which its splitter leaves whole.  Texts with "<|",
which may be special, are encoded whole.  All this holds for one kind of
normaliser and splitter (``_NORMALIZER``, ``_SPLITTER``); with any other, every
text is encoded whole by the library.  A test compares both with the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .textcore import WS, kept, slices, span_hashes, word_bounds

_MOST_WORDS = 200_000
# a head that ends in a letter or digit, and ASCII marks behind it: no rule of the tokenizer joins the two
_TAIL = re.compile(r"(.*[^\W_])([!-/:-@\[-`{-~]+)", re.DOTALL)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable and no space, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i if i in own else next(rest)) for i in range(256)]


# The parts of a tokenizer file for which words may be looked up one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(path: str) -> bool:
    """Whether the words of a text have the same ids alone as within it."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    return parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _SPLITTER and not parts["post_processor"] and all(t["content"].startswith("<|") for t in parts["added_tokens"])


def id_bits(path: str) -> int:
    """Bits that the largest id of the file's vocabulary needs."""
    return max(1, max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0).bit_length())


class _Ids(dict):
    """Word (UTF-8) -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        """What the splitter leaves whole, normalised, each byte as its letter."""
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            found = self.part(word.lower().decode())
        else:
            text = word.decode()
            if (m := _TAIL.fullmatch(text)) and m[1][-1].lower()[-1].isalnum():
                found = self[m[1].encode()] + self[m[2].encode()]
            elif text.isalpha() and (low := "".join(map(str.lower, text))).isalpha() and unicodedata.is_normalized("NFC", text):
                found = self.part("".join(map(self.letters.__getitem__, low.encode())))
            else:
                found = self.whole(text)
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = found
        return found


_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[i for i in range(128) if chr(i).isalnum()]] = True


def prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice with a space between an ASCII letter or digit and the marks that end its word, and its ASCII words in lower case."""
    mark = _MARK[data]
    at = np.flatnonzero(mark[1:] & _ALNUM[data[:-1]]) + 1
    row = np.searchsorted(offsets, at, "right")
    same = offsets[row - 1] < at  # the letter is of the same row
    at, row_end = at[same], offsets[row[same]]
    other = np.append(np.flatnonzero(~mark), len(data))
    behind = other[np.searchsorted(other, at)]  # what follows the run of marks
    at = at[(behind >= row_end) | WS[data[np.minimum(behind, len(data) - 1)]]]
    data = np.insert(data, at, 32)
    offsets = offsets + np.searchsorted(at, offsets)
    begins, ends, _ = word_bounds(data, offsets)
    wide = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data >= 128, out=wide[1:])
    plain = wide[begins] == wide[ends]
    step = np.zeros(len(data) + 1, np.int8)
    step[begins[plain]] += 1
    step[ends[plain]] -= 1
    upper = (np.cumsum(step[:-1], dtype=np.int8) > 0) & (data >= 65) & (data <= 90)
    data[upper] += 32
    return data, offsets


def token_bytes(texts: pa.Array, path: str) -> Iterator[bytes]:
    """For each text (null: empty) its ids, four bytes each, in order."""
    ids = kept(("tokens", path), lambda: _Ids(path))
    for a, b, data, offsets in slices(texts):
        raw = data.tobytes()
        if b"<|" in raw or not ids.by_words:
            at = offsets.tolist()
            yield from (ids.whole(raw[x:y].decode()) for x, y in zip(at[:-1], at[1:], strict=True))
            continue
        data, offsets = prepared(data, offsets)
        begins, ends, first = word_bounds(data, offsets)
        _, at, which = np.unique(span_hashes(data, begins, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        values = [ids[raw[x:y]] for x, y in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        count = size[which]
        total = np.append(0, np.cumsum(count))
        out = np.frombuffer(b"".join(values), "<u4")[np.repeat(start[which] - total[:-1], count) + np.arange(total[-1])].tobytes()
        edges = (4 * total[first]).tolist()
        yield from (out[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True))
