"""Token ids of whole Arrow columns of texts, by the tokenizers library with its default settings.

Texts are cut, inside Arrow, where no token of the byte-level pattern reaches across; the pieces
of a batch are numbered, only pieces not met before go through the library, and the ids of all
texts are gathered in numpy. Strings of special tokens in a text become those tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AT_ONCE = 1 << 22  # bytes of text cut at once; a longer text is cut alone
REMEMBERED = 500_000  # pieces whose ids a process keeps, about 100 MB

CUT = "\x01"
#: A wider class than white space of the pattern, and a narrower one.
WIDE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}"
AFTER_WORD = re.compile("(?<=[^\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff])(?=[ \\t\\r\\n])")


class Encoder:
    """Ids of texts; a process keeps the ids of the pieces it has met.

    A run of white space is one token but for its last character, so a cut before each blank and
    around each line feed is safe in runs of one or two; texts with longer runs, or with two or
    more characters of white space at the end, are cut only where white space begins. A stop or
    comma after a letter begins a token. Tokenizers of another pattern encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        parts = json.loads(self.library.to_str())
        before = parts.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and parts.get("normalizer") is None
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        #: a special token that ends one piece and begins the next, so that many are learnt in one text
        self.mark_id, self.mark = next(((k, t.content) for k, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), (None, None))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of piece k in ids; it begins where piece k - 1 ends

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        n, used = len(self.number), int(self.ends[len(self.number) - 1]) if self.number else 0
        if self.mark is None:
            found = self._library_ids(pieces)
            ends = used + np.cumsum([len(x) for x in found])
        else:
            found = self._library_ids([self.mark.join(pieces[k : k + 256]) + self.mark for k in range(0, len(pieces), 256)])
            joined = np.concatenate(found)
            at = np.flatnonzero(joined == self.mark_id)
            ends = used + at - np.arange(len(at))
            found = [joined[joined != self.mark_id]]
        for name, need in (("ids", int(ends[-1])), ("ends", n + len(pieces))):
            if need > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(need, getattr(self, name).dtype)]))
        self.ids[used : ends[-1]] = np.concatenate(found)
        self.ends[n : n + len(pieces)] = ends
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, the unknown ones learnt."""
        numbers = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown) and len(self.number) + len(unknown) > REMEMBERED:
            self._forget()
            unknown = np.arange(len(pieces))
        if len(unknown):
            numbers[unknown] = len(self.number) + np.arange(len(unknown))
            self._learn([pieces[k] for k in unknown.tolist()])
        return numbers

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text."""
        odd = pc.or_(pc.match_substring_regex(texts, f"[{WIDE}]{{3}}|[{WIDE}]{{2}}$"), pc.match_substring(texts, CUT))
        plain = pc.if_else(odd, "", texts)
        marked = pc.replace_substring(plain, " ", CUT + " ")
        marked = pc.replace_substring(marked, "\n", CUT + "\n" + CUT)
        marked = pc.replace_substring_regex(marked, r"(\pL)([.,])", "\\1" + CUT + "\\2")
        cut = pc.split_pattern(marked, CUT)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(at):
            rows = cut.to_pylist()
            for k in at.tolist():
                rows[k] = AFTER_WORD.split(texts[k].as_py())
            cut = pa.array(rows, cut.type)
        return cut

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where those of each begin and the last end)."""
        whole = np.full(len(texts), not self.cuts)
        for mark in self.added:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        cut = self._cut(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        row_ends = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        begins = np.where(numbers > 0, self.ends[numbers - 1], 0)
        sizes = self.ends[numbers] - begins
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[row_ends]
        if not whole.any():
            return ids, bounds
        at = np.flatnonzero(whole).tolist()
        found = dict(zip(at, self._library_ids([texts[k].as_py() for k in at]), strict=True))
        parts = [found[k] if whole[k] else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, which later tasks find again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds of the rows in them) for runs of rows; a null text is empty."""
    own = encoder(path)
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string()) if texts.nbytes < 1 << 30 else texts
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    first = 0
    while first < len(texts):
        done = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
        ids, bounds = own.encode(texts.slice(first, last - first))
        yield first, ids, bounds
        first = last
