"""Token ids of a word-level `tokenizers` file, one distinct word at a time.

Used by the token writer and the token counter. The tokenizers library encodes each
distinct word; texts are put together from the words' ids. That gives the ids of the
whole text exactly if the file's pre-tokeniser drops white space and never matches across
it, which is checked when the file is loaded; other files encode whole texts. The writer
goes on to the pre-tokeniser's matches within words, of which there are fewer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reviewmill.llm.common import LOWER, SPACE

CACHED_WORDS = 400_000
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters of the Latin blocks, whose lower case and NFC form don't depend on their neighbours.
_LATIN = "\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^ \t-\ra-z0-9{_LATIN}]+").findall
_WHOLE = re.compile(f"[a-z{_LATIN}]+|[0-9]").fullmatch
# Lower case of the Latin letters by code point; 0 where it isn't one letter of these blocks.
_LOWERED = np.zeros(0x280, np.uint16)
for _c in range(0xC0, 0x250):
    if _c not in (0xD7, 0xF7) and len(chr(_c).lower()) == 1 and ord(chr(_c).lower()) < 0x250:
        _LOWERED[_c] = ord(chr(_c).lower())
_HARD = f"[^!-~{''.join(map(chr, np.flatnonzero(_LOWERED).tolist()))}]"
# Kinds of bytes: white space, letters, digits, marks, and those of characters left to the library.
_GAP, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[SPACE] = _GAP
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER


class WordTokens:
    """The tokenizer of one file; build it once per Python worker."""

    _made: dict[str, WordTokens] = {}

    @classmethod
    def load(cls, path: str) -> WordTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as text:
            config = json.load(text)
        self.hard = re.compile("|".join([_HARD, *(re.escape(t["content"]) for t in config["added_tokens"])])).search
        self.special = [t["content"].encode() for t in config["added_tokens"]]
        self.letters = self._byte_letters()
        self.by_word = self._drops_space(config)
        self.plain: dict[str, bytes] = {}
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts = pa.array([], pa.large_binary())
        self.part_ids = pa.array([], pa.large_list(pa.uint32()))
        self.uses = np.zeros(0, np.int32)

    @staticmethod
    def _drops_space(config: dict) -> bool:
        """Lower-casing after NFC, splits by the known pattern, and no padding, truncation or stripping."""
        steps = [s.get("type") for s in (config.get("normalizer") or {}).get("normalizers", [])]
        first, *rest = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and first.get("pattern") == {"Regex": _SPLIT}
            and first.get("behavior") == "Removed" and first.get("invert") is True
            and all(s.get("type") == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in rest)
            and not config.get("truncation") and not config.get("padding") and not config.get("post_processor")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or t["content"].isalnum()
                        for t in config["added_tokens"])
        )

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as native (little-endian) 32-bit integers."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [array("I", c.ids).tobytes() for c in coded]
        words = [t.split() for t in texts]
        known = self._known(set().union(*words))
        return [b"".join(map(known, row)) for row in words]

    def joined(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, which lie one after another, and how many each text has.

        The texts are split by numpy and their parts numbered by Arrow, so Python meets a part
        once, however often it occurs; the parts' ids are put together by their numbers.
        """
        if not self.by_word:
            coded = self.encode([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.frombuffer(b"".join(coded), np.uint32), np.array([len(c) // 4 for c in coded], np.int64)
        begins = offsets - offsets[0]
        starts, lengths, held = self._parts(begins, data[offsets[0]:offsets[-1]])
        bounds = np.append(0, np.cumsum(lengths))
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
        numbers = self._numbers(parts)
        lists = self.part_ids.take(pa.array(numbers))
        at = lists.offsets.to_numpy()[np.searchsorted(starts, begins)]
        self._drop_rare(numbers)
        return lists.flatten().to_numpy(), np.diff(at)

    def _drop_rare(self, numbers: np.ndarray) -> None:
        """Count the parts in use; if there are too many, those met once before go."""
        used = np.zeros(len(self.parts), bool)
        used[numbers] = True
        self.uses += used
        if len(self.parts) > CACHED_WORDS:
            kept = used | (self.uses > 1)
            self.parts, self.part_ids = self.parts.filter(pa.array(kept)), self.part_ids.filter(pa.array(kept))
            self.uses = self.uses[kept] // 2

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Each part's place among the numbered ones; new ones are learned and added."""
        found = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(found.is_null()).dictionary_encode()
        words = new.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = list(map(self._known(set(words)), words))
        self.cache, self.older, self.plain = {}, {}, {}  # what is numbered needs no second place
        ends = np.append(0, np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4))
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.uint32)))
        out = found.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        out[out < 0] = len(self.parts) + new.indices.to_numpy()
        self.parts, self.part_ids = pa.concat_arrays([self.parts, new.dictionary]), pa.concat_arrays([self.part_ids, ids])
        self.uses = np.append(self.uses, np.zeros(len(words), np.int32))
        return out

    def _parts(self, begins: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the texts' parts, and the bytes of all parts one after another.

        A part is a lower-case match of the pre-tokeniser. Words with other than ASCII marks and
        Latin letters, a special token or an apostrophe before a letter are one part as they are.
        """
        n = len(data)
        kind, lower = _KIND[data], LOWER[data]
        at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # two-byte characters
        small = _LOWERED[(data[at] & np.uint16(0x1F)) << np.uint16(6) | data[at + 1] & np.uint16(0x3F)]
        at, small = at[small > 0], small[small > 0]
        kind[at] = kind[at + 1] = _LETTER
        lower[at], lower[at + 1] = small >> 6 | 0xC0, small & 0x3F | 0x80
        cut = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[:-1] |= kind == _DIGIT
        cut[begins] = True
        quotes = np.flatnonzero(data[:-1] == 0x27)
        whole = [np.flatnonzero((kind == _OTHER) & cut[:-1]), quotes[kind[quotes + 1] == _LETTER]]
        text = data.tobytes() if self.special else b""
        for token in self.special:
            whole.append(np.array([m.start() for m in re.finditer(re.escape(token), text)], np.int64))
        whole = np.concatenate(whole)
        if len(whole):
            edge = np.append(kind == _GAP, True)
            edge[begins] = True
            edges = np.flatnonzero(edge)  # a word lies between two of them
            word = np.unique(np.searchsorted(edges, whole, "right"))
            low, high = edges[word - 1], edges[word]
            low = low + (kind[low] == _GAP)
            depth = np.zeros(n + 1, np.int8)
            depth[low] += 1
            depth[high] -= 1
            inside = np.cumsum(depth[:-1], dtype=np.int8).view(bool)
            np.copyto(lower, data, where=inside)
            cut[:-1] &= ~inside
            cut[low] = cut[high] = True
        cuts = np.flatnonzero(cut)
        kept = kind[cuts[:-1]] != _GAP
        return cuts[:-1][kept], np.diff(cuts)[kept], lower[kind != _GAP]

    def _known(self, words: set[bytes]) -> Callable[[bytes], bytes]:
        """The ids of these words by word; new ones are learned, words in use move on from the older half."""
        if len(self.cache) > CACHED_WORDS // 2:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        missing = words.difference(cache)
        old = missing.intersection(older)
        cache.update(zip(old, map(older.__getitem__, old)))
        self._learn(missing - old)
        return cache.__getitem__

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """What the byte-level step makes of each Latin letter: one printable letter per byte."""
        shown = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
        hidden = [b for b in range(256) if b not in shown]
        shown.update((b, chr(256 + i)) for i, b in enumerate(hidden))
        return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words; Latin ones are lower-cased, split and given to the model directly."""
        if not words:
            return
        raw = list(words)
        lower = b"\n".join(raw).decode().lower().split("\n")  # words hold no white space
        whole = list(map(_WHOLE, lower))
        pieces = list(compress(lower, whole))
        self._model_ids(set(pieces))
        done = list(compress(raw, whole))
        self.cache.update(zip(done, map(self.plain.__getitem__, pieces)))
        if len(done) < len(raw):
            self._learn_mixed(words.difference(done))
        if len(self.plain) > CACHED_WORDS // 2:
            self.plain.clear()

    def _learn_mixed(self, words: set[bytes]) -> None:
        """Ids of words of several pieces or with characters left to the library."""
        raw = list(words)
        rest = list(compress(raw, map(self.hard, b"\n".join(raw).decode().split("\n"))))
        easy = list(words.difference(rest))
        pieces = list(map(_PIECES, b"\n".join(easy).decode().lower().split("\n"))) if easy else []
        self._model_ids(set().union(*pieces))
        known = self.plain.__getitem__
        self.cache.update(zip(easy, [b"".join(map(known, p)) for p in pieces]))
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.cache.update((w, array("I", c.ids).tobytes()) for w, c in zip(rest, coded))

    def _model_ids(self, pieces: set[str]) -> None:
        letters, tokenize = self.letters, self.tokenizer.model.tokenize
        new = list(pieces.difference(self.plain))
        shown = [p if p.isascii() else p.translate(letters) for p in new]
        self.plain.update(zip(new, [array("I", [t.id for t in tokenize(p)]).tobytes() for p in shown]))
