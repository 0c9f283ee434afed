"""Token ids of whole texts by the tokenizers library, word by word through a table of the words met so far.

For tokenizers that drop white space before they split, a text's ids are the ids of its words (between ASCII white
space) in order. Most words repeat, so each Python worker keeps a bounded table of them and gives only new ones to
the library. Lookups are array operations over a group of texts: a word of up to 16 bytes is known exactly by its
first eight bytes, its last eight and its length; longer ones are in a dictionary.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: A word that ends in ASCII punctuation, and what stands before that.
_TAILED = re.compile(rb"(.*[^!-/:-@\[-`{-~])([!-/:-@\[-`{-~]+)", re.S)


class WordTokenizer:
    """encode() gives ids; type is their little-endian NumPy type, size the number of ids."""

    SLOTS = 21  # bits
    WORDS = 1_200_000
    LONG_WORDS = 300_000
    GROUP = 1 << 20  # bytes of text that are looked up together

    def __init__(self, path: str, end: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have a Python worker each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end = end
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        self.closes = np.zeros(self.size, bool)  # ids that close a piece, if they can be told
        if suffix:
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        # case is left to the library, unless it is seen to drop it
        upper, lower = self._one_by_one([b"aZ", b"az"])
        self.folds = upper.tolist() == lower.tolist()
        self.tails: dict[tuple[bytes, bytes], bool] = {}  # whether a letter and the punctuation behind it are parted
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.SLOTS
        # of each slot its word's two mixes and its entry plus one, side by side: a lookup touches one line of memory
        self.table = np.zeros((n, 4), np.uint64)
        self.starts, self.counts = np.zeros(self.WORDS + 1, np.int32), np.zeros(self.WORDS + 1, np.int32)
        self.flat, self.n_flat, self.n = np.zeros(1 << 20, self.type), 0, 0
        self.long: dict[bytes, int] = {}
        self._insert([b"\xff"], np.array([self.end]), np.array([1]))

    def _one_by_one(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _library(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in another order, their ids one after another, and how many each has.

        Words of letters alone are one piece each: they go to the library in long texts, which are parted where a piece
        closes. A text that doesn't part into as many pieces is asked for word by word.
        """
        order: list[bytes] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rest = words
        if self.closes.any():
            said = [w.decode() for w in words]
            simple = [w for w in said if w.isalpha()]
            rest = [w for w, t in zip(words, said, strict=True) if not t.isalpha()]
            texts = [simple[i : i + 400] for i in range(0, len(simple), 400)]
            for part, e in zip(texts, self.tokenizer.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False), strict=True):
                found = np.array(e.ids)
                ends = np.flatnonzero(self.closes[found]) + 1
                if len(ends) == len(part) and ends[-1] == len(found):
                    order += [w.encode() for w in part]
                    ids.append(found)
                    counts.append(np.diff(ends, prepend=0))
                else:
                    rest += [w.encode() for w in part]
        each = self._one_by_one(rest)
        return order + rest, np.concatenate([np.zeros(0, np.int64), *ids, *each]), np.concatenate([np.zeros(0, np.int64), *counts, np.fromiter(map(len, each), np.int64, len(each))]).astype(np.int64)

    def _cut(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Words of letters with punctuation behind, as (letters, punctuation), where the library is seen to part such a pair."""
        found = {w: m.groups() for w in words if (m := _TAILED.fullmatch(w)) and len(m[2]) <= 8 and m[1].decode().isalpha()}
        ends = {w: (p[0].decode()[-1].encode(), p[1]) for w, p in found.items()}
        if len(self.tails) > self.LONG_WORDS:
            self.tails.clear()
        new = sorted(set(ends.values()) - self.tails.keys())
        if new:
            said = [x.tolist() for x in self._one_by_one([x for a, t in new for x in (a, t, a + t)])]
            self.tails |= {p: said[3 * i] + said[3 * i + 1] == said[3 * i + 2] for i, p in enumerate(new)}
        return {w: p for w, p in found.items() if self.tails[ends[w]]}

    def _learn(self, words: set[bytes]) -> None:
        parted = self._cut(words)
        ask = list((words - parted.keys()).union(*parted.values()))
        ask = [w for w, e in zip(ask, self._entries(ask).tolist(), strict=True) if e < 0]
        self._insert(*self._library(ask))
        if parted:
            stem, close = (self._entries([p[i] for p in parted.values()]) for i in (0, 1))
            pieces = np.stack([stem, close], 1).ravel()
            counts = self.counts[pieces].astype(np.int64)
            self._insert(list(parted), self._ids(pieces, counts), counts.reshape(-1, 2).sum(1))

    def _ids(self, entry: np.ndarray, counts: np.ndarray) -> np.ndarray:
        stops = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[entry] - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0)]

    @staticmethod
    def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Words in one text with eight bytes to spare, where they start, and where they end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = 8 + np.cumsum(sizes + 1) - 1
        return b" " * 8 + b" ".join(words) + b" " * 8, ends - sizes, ends

    def _entries(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        raw, starts, ends = self._joined(words)
        entry = self._find(*self._keys(raw, starts, ends))
        for i in np.flatnonzero(ends - starts > 16):
            entry[i] = self.long.get(words[i], -1)
        return entry

    def _keys(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit mixes of each word that together are one to one for words of up to 16 bytes; raw has eight bytes to spare at both ends."""
        eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        n = ends - starts
        first = eights[starts] & _MASKS[np.minimum(n, 8)]
        last = np.where(n > 8, eights[ends - 8], n.astype(np.uint64))
        size = n.astype(np.uint64)
        key = (first * _MIX[0]) ^ (last * _MIX[1] + size)
        key = (key ^ (key >> np.uint64(29))) * _MIX[2]
        return key ^ (key >> np.uint64(32)), first + last * _MIX[3] + (size << np.uint64(56))

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        slot = (key >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        rows = self.table.take(slot, 0)
        entry = rows[:, 2].astype(np.int64) - 1
        hit = (rows[:, 0] == key) & (rows[:, 1] == check)
        found = np.where(hit, entry, -1)  # an empty slot's entry is -1 too
        left = np.flatnonzero(~hit & (entry >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.SLOTS) - 1)
            rows = self.table.take(slot, 0)
            entry = rows[:, 2].astype(np.int64) - 1
            hit = (rows[:, 0] == key[left]) & (rows[:, 1] == check[left]) & (entry >= 0)
            found[left[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            left, slot = left[on], slot[on]
        return found

    def _insert(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """New words, their ids one after another, and how many each has."""
        if not words:
            return
        first, total = self.n, len(ids)
        while self.n_flat + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.n_flat : self.n_flat + total] = ids
        self.starts[first : first + len(words)] = self.n_flat + np.cumsum(counts) - counts
        self.counts[first : first + len(words)] = counts
        self.n, self.n_flat = first + len(words), self.n_flat + total
        at = np.arange(first, self.n)
        raw, starts, ends = self._joined(words)
        for i in np.flatnonzero(ends - starts > 16):
            self.long[words[i]] = first + int(i)
        short = ends - starts <= 16
        key, check = self._keys(raw, starts[short], ends[short])
        at = at[short]
        slot = (key >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        while len(at):
            _, pick = np.unique(slot, return_index=True)
            pick = pick[self.table[slot[pick], 2] == 0]
            self.table[slot[pick], 0], self.table[slot[pick], 1], self.table[slot[pick], 2] = key[pick], check[pick], at[pick] + 1
            on = np.ones(len(at), bool)
            on[pick] = False
            key, check, at, slot = key[on], check[on], at[on], (slot[on] + 1) & ((1 << self.SLOTS) - 1)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and the place where each text's ids end."""
        out, ends, group, size, total = [], [], [], 0, 0
        for i, t in enumerate(texts):
            t = t or b""
            # special tokens are told before case is dropped, so their texts keep it
            group.append(t.lower() if self.folds and b"<|" not in t else t)
            size += len(t)
            if size >= self.GROUP or i == len(texts) - 1:
                ids, stops = self._group(group)
                out.append(ids)
                ends.append(stops + total)
                total += len(ids)
                group, size = [], 0
        return (np.concatenate(out), np.concatenate(ends)) if out else (np.zeros(0, self.type), np.zeros(0, np.int64))

    def _group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" " * 8 + b" \xff ".join(texts) + b" \xff" + b" " * 8  # a byte that no text has is the end's word
        gap = _BLANK[np.frombuffer(raw, np.uint8)]
        turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = turn[::2], turn[1::2]
        ids, counts = self._looked_up(raw, starts, ends)
        closing = np.frombuffer(raw, np.uint8)[starts] == 255
        return ids, np.cumsum(counts)[closing]

    def _looked_up(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of raw at these places, and how many each has; in several rounds if the table can't hold all."""
        long = np.flatnonzero(ends - starts > 16)
        key, check = self._keys(raw, starts, ends)
        words = [raw[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        for fresh in (False, True):
            entry = self._find(key, check)
            entry[long] = [self.long.get(w, -1) for w in words]
            lost = np.flatnonzero(entry < 0)
            if not len(lost):
                break
            missing = {raw[s:e] for s, e in zip(starts[lost].tolist(), ends[lost].tolist(), strict=True)}
            full = self.n + 3 * len(missing) > self.WORDS  # each word, its letters and its punctuation
            if not fresh and (full or len(self.long) > self.LONG_WORDS):
                self._clear()
                continue
            if full:
                step = (self.WORDS - 1) // 3  # as many words as an empty table surely holds
                parts = [self._looked_up(raw, starts[i : i + step], ends[i : i + step]) for i in range(0, len(starts), step)]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            self._learn(missing)
        entry = self._find(key, check)
        entry[long] = [self.long[w] for w in words]
        counts = self.counts[entry].astype(np.int64)
        return self._ids(entry, counts), counts
