"""Re-Pair grammar compression of token ids, in blocks that decode alone and in part.

A block holds the ids of consecutive documents. In each round all adjacent pairs of the block's symbols that occur often
enough become nonterminals and their occurrences, leftmost first, are replaced; a pair never spans two documents. Rounds
end when no pair occurs ``LEAST`` times. Stored are the rules (pairs of symbols), the length that each nonterminal expands
to, and the remaining symbols. The lengths' running sum finds the symbols that cover any range of ids, so a single document
is decoded without the rest of its block.
"""

from __future__ import annotations

import dataclasses

import numpy as np

LEAST = 16
CELLS = 18  # bits of the table that tells which pairs may be frequent
_LEFT, _RIGHT = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)


@dataclasses.dataclass
class Block:
    """terminals: ids below this stand for themselves; symbol terminals + i stands for rules[i]."""

    terminals: int
    rules: np.ndarray  # (n, 2) uint32
    lengths: np.ndarray  # (n,) uint32, ids that each nonterminal expands to
    symbols: np.ndarray  # uint32
    n_ids: int

    def columns(self) -> tuple[int, bytes, bytes, int, bytes]:
        """For storage; symbols take two bytes each where they fit."""
        width = 2 if self.terminals + len(self.rules) <= 1 << 16 else 4
        return self.terminals, self.rules.astype("<u4").tobytes(), self.lengths.astype("<u4").tobytes(), width, self.symbols.astype(f"<u{width}").tobytes()

    @classmethod
    def of(cls, terminals: int, rules: bytes, lengths: bytes, width: int, symbols: bytes, n_ids: int) -> Block:
        return cls(terminals, np.frombuffer(rules, "<u4").reshape(-1, 2), np.frombuffer(lengths, "<u4"), np.frombuffer(symbols, f"<u{width}").astype(np.uint32), n_ids)

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The nonterminals' expansions, one after another, and where each starts."""
        lengths = self.lengths.astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.zeros(starts[-1], np.uint32)
        parts = self.rules.astype(np.int64)
        plain = parts < self.terminals
        inner = np.where(plain, 0, parts - self.terminals)
        sizes = np.where(plain, 1, lengths[inner] if len(lengths) else 1)
        to = starts[:-1, None] + np.stack([np.zeros(len(parts), np.int64), sizes[:, 0]], 1)
        flat[to[plain]] = parts[plain]
        done = plain.copy()
        while not done.all():  # as many rounds as the rules nest
            ready = ~done & done.all(1)[inner]
            size, source, target = sizes[ready], starts[:-1][inner[ready]], to[ready]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            flat[np.repeat(target, size) + step] = flat[np.repeat(source, size) + step]
            done |= ready
        return flat, starts

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids at places start to stop, as uint32; expands only the symbols that cover them."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        t = self.terminals
        size = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= t
        size[rule] = self.lengths[self.symbols[rule] - t]
        ends = np.cumsum(size)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        symbols, size = self.symbols[first : last + 1], size[first : last + 1]
        before = ends[first] - size[0]
        flat, starts = self.expansions()
        pool = np.concatenate([flat, symbols])  # terminals are read from their own place after the expansions
        source = len(flat) + np.arange(len(symbols))
        rule = symbols >= t
        source[rule] = starts[symbols[rule] - t]
        at = np.cumsum(size) - size
        out = pool[np.repeat(source - at, size) + np.arange(size.sum())]
        return out[start - before : stop - before]


def _every_other(places: np.ndarray) -> np.ndarray:
    """Of each run of adjacent places, ascending, the first, third and so on: a mask."""
    run = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return (np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))) % 2 == 0


def frequent(left: np.ndarray, right: np.ndarray, hot: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur least times among the places hot, ascending, the places that have one, and which.

    Counts are exact; of a run of one symbol every other place counts. Only pairs of a well-filled cell of a hash table
    are counted, as others can't be frequent.
    """
    a, b = left[hot], right[hot]
    cell = ((a * _LEFT + b) * _RIGHT) >> np.uint32(32 - CELLS)
    full = (np.bincount(cell, minlength=1 << CELLS) >= least)[cell]
    hot, a, b, cell = hot[full], a[full], b[full], cell[full]
    key = a.astype(np.uint64) << np.uint64(32) | b
    twin = np.flatnonzero(a == b)
    counted = np.ones(len(hot), bool)
    counted[twin[~_every_other(hot[twin])]] = False
    ordered = np.sort(key[counted])
    first = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
    pairs = ordered[first[np.diff(np.append(first, len(ordered))) >= least]]
    if not len(pairs):
        return pairs, hot[:0], hot[:0]
    # which of the pairs each place has: looked up by cell, and by bisection where pairs share a cell
    table = np.full(1 << CELLS, -1, np.int32)
    at = (((pairs >> np.uint64(32)).astype(np.uint32) * _LEFT + pairs.astype(np.uint32)) * _RIGHT) >> np.uint32(32 - CELLS)
    table[at] = np.arange(len(pairs))
    which = table[cell]
    on = which >= 0
    hot, key, which = hot[on], key[on], which[on]
    hit = pairs[which] == key
    hidden = np.flatnonzero(table[at] != np.arange(len(pairs)))
    if len(hidden):
        miss = np.flatnonzero(~hit)
        near = np.minimum(np.searchsorted(pairs[hidden], key[miss]), len(hidden) - 1)
        same = pairs[hidden][near] == key[miss]
        which[miss[same]] = hidden[near[same]]
        hit[miss[same]] = True
    return pairs, hot[hit], which[hit]


def compress(ids: np.ndarray, end: int, terminals: int, least: int = LEAST) -> Block:
    """Re-Pair over ids (all below terminals); no pair goes past an id end, so documents stay apart.

    least: how often a pair must occur, 2 at least. The result has no pair that occurs so often.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(terminals, np.uint32)
    closes = np.zeros(terminals, bool)  # symbols that end a document
    if end < terminals:
        closes[end] = True
    new = 0  # symbols from here on are the last round's: no other pair can have become frequent
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        hot = ~closes[left]
        if new:
            hot &= (left >= new) | (right >= new)
        pairs, hot, which = frequent(left, right, np.flatnonzero(hot), max(2, least))
        if not len(pairs):
            break
        taken = _every_other(hot)  # of overlapping occurrences the leftmost
        hot, which = hot[taken], which[taken]
        used = np.zeros(len(pairs), bool)
        used[which] = True
        name = np.cumsum(used) - 1 + len(lengths)
        seq = seq.copy()
        seq[hot] = name[which].astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hot + 1] = False
        seq = seq[keep]
        pairs = pairs[used]
        both = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(both)
        new = len(lengths)
        lengths = np.concatenate([lengths, lengths[both[:, 0]] + lengths[both[:, 1]]])
        closes = np.concatenate([closes, closes[both[:, 1]]])
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return Block(terminals, table, lengths[terminals:], seq, len(ids))
