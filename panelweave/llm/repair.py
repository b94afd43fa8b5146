"""Re-Pair grammar compression of one shard of token ids, vectorised.

Rounds replace frequent pairs of neighbouring symbols by new symbols until no pair occurs twice. A round
counts pairs exactly and replaces, at every place, the pair that is more frequent than those it overlaps;
the least count falls from round to round, so frequent pairs go first. A pair never spans the end symbol,
so documents stay apart. In the end a rule that costs more than it saves is written out where it is used;
right-hand sides thus have any length, and a passage found twice is one rule. Every rule's expansion
length is kept: the running sum over the sequence finds the symbols of any token range, which alone are
expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 20  # of the hashed counters that tell which pairs are worth sorting
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
RULE_COST = 3  # what a rule takes beside its right-hand side, in symbols


def spread(symbols: np.ndarray, grow: np.ndarray, begin: np.ndarray, size: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` with each one where ``grow`` holds replaced by ``size`` entries of ``table`` from ``begin``; and the place each came from."""
    size = np.where(grow, size, 1)
    ends = np.cumsum(size)
    origin = np.repeat(np.arange(len(symbols)), size)
    out = symbols[origin]
    inner = np.flatnonzero(grow[origin])
    came = origin[inner]
    out[inner] = table[begin[came] + inner - (ends[came] - size[came])]
    return out, origin


@dataclass
class Grammar:
    """``first`` is the id of the first rule; rule r stands for ``sizes[r]`` symbols of ``right``, after those of the rules before it."""

    first: int
    sizes: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  # expansion length of each rule
    symbols: np.ndarray

    def symbol_lengths(self) -> np.ndarray:
        out = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.first
        out[rule] = self.lengths[self.symbols[rule] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of these symbols; only the rules reached are looked at."""
        sizes, seq = self.sizes.astype(np.int64), symbols.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        while (grow := seq >= self.first).any():
            rule = np.where(grow, seq - self.first, 0)
            seq, _ = spread(seq, grow, starts[rule], sizes[rule], self.right)
        return seq.astype(np.uint32)

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids ``start`` to ``stop``; only the symbols that overlap the range are expanded."""
        ends = np.cumsum(self.symbol_lengths())
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.symbols[a:b])[skip:skip + stop - start]


def every_other(at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the ascending places ``at`` to keep: of a run of places of one symbol twice (``same``) every other one, so none overlap."""
    keep, of = np.ones(len(at), bool), np.flatnonzero(same)
    run = np.concatenate([[True], np.diff(at[of]) != 1])
    begins = np.flatnonzero(run)
    keep[of] = ((np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))) & 1) == 0
    return keep


class Sequence:
    """A sequence under compression; ``alive`` holds where a pair begins that may occur again.

    A pair found less than ``least`` times can only grow rarer, so its places rest until a neighbour changes.
    """

    def __init__(self, ids: np.ndarray, end: int, least: int):
        self.symbols, self.end, self.least = ids.astype(np.int64), end, least
        self.alive = np.ones(len(ids), bool)
        self.alive[-1:] = False

    def round(self, base: int, share: int) -> tuple[np.ndarray, int]:
        """Replaces pairs, the first by ``base``; returns them, (n, 2), and the least count of this round.

        Only pairs found at least 1/``share`` as often as the most frequent one take part, and ``least`` times in any case.
        """
        seq, alive, least = self.symbols, self.alive, self.least
        at = np.flatnonzero(alive)
        a, b = seq[at], seq[at + 1]
        free = (a != self.end) & (b != self.end)
        alive[at[~free]] = False
        at, key, same = at[free], (a << 32 | b)[free], (a == b)[free]
        if same.any():
            apart = every_other(at, same)
            at, key = at[apart], key[apart]
        if not len(at):
            return np.empty((0, 2), np.int64), least
        bits = min(BITS, len(at).bit_length() + 1)
        slot = (key.view(np.uint64) * GOLDEN >> np.uint64(64 - bits)).astype(np.int32)
        bound = np.bincount(slot, minlength=1 << bits)  # never below a pair's own count
        used, bound = max(least, int(bound.max()) // share), bound[slot]
        alive[at[bound < least]] = False
        some = bound >= used
        at, key = at[some], key[some]
        order = np.argsort(key)
        at, key = at[order], key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(begins, len(at)))
        group = np.repeat(np.arange(len(begins)), counts)
        count = counts[group]
        alive[at[count < least]] = False
        often = count >= used
        at, group, count = at[often], group[often], count[often]
        rank = np.zeros(len(seq) + 1, np.int64)  # by count, then by pair: no two neighbours are equal
        rank[at + 1] = mine = count << 32 | group
        win = (mine > rank[at]) & (mine > rank[at + 2])
        won = np.bincount(group[win], minlength=len(begins))
        win &= won[group] >= least
        at, group = at[win], group[win]
        number = np.cumsum(won >= least) - 1
        pairs = key[begins[won >= least]]
        seq[at] = base + number[group]
        alive[at] = alive[np.maximum(at - 1, 0)] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        self.symbols, self.alive = seq[stay], alive[stay]
        self.alive[-1:] = False
        return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1), used


def compress(ids: np.ndarray, vocabulary: int, end: int, least: int = 2, share: int = 8) -> Grammar:
    """Grammar of ``ids``; ``end`` never enters a rule.

    ``vocabulary`` is the first free id. Rounds go on until no pair is found ``least`` times without overlap. An
    empty sequence gives an empty grammar.
    """
    seq, rounds, n = Sequence(ids, end, least), [], 0
    while True:
        pairs, used = seq.round(vocabulary + n, share)
        if len(pairs):
            rounds.append(pairs)
            n += len(pairs)
        elif used == least:
            return pruned(vocabulary, rounds, seq.symbols)
        else:
            share *= 4  # none was as frequent as the hashed bound


def pruned(first: int, rounds: list[np.ndarray], seq: np.ndarray) -> Grammar:
    """The grammar of the pairs of each round, without rules that do not pay."""
    pairs = np.concatenate([np.empty((0, 2), np.int64), *rounds])
    n = len(pairs)
    every = np.concatenate([seq, pairs.ravel()])
    uses = np.bincount(every[every >= first] - first, minlength=n)
    lengths, size, keep, at = np.ones(n, np.int64), np.ones(n, np.int64), np.zeros(n, bool), 0
    for part in rounds:  # the parts of a rule are of earlier rounds
        here = slice(at, at + len(part))
        inner, rule = part >= first, np.maximum(part - first, 0)
        lengths[here] = np.where(inner, lengths[rule], 1).sum(1)
        size[here] = np.where(inner & ~keep[rule], size[rule], 1).sum(1)
        keep[here] = uses[here] * size[here] > uses[here] + size[here] + RULE_COST
        at += len(part)
    kept, flat = np.flatnonzero(keep), pairs.ravel()
    number = first + np.cumsum(keep) - 1

    def written(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while True:
            rule = np.maximum(symbols - first, 0)
            grow = (symbols >= first) & ~keep[rule] if n else np.zeros(len(symbols), bool)
            if not grow.any():
                return (np.where(symbols >= first, number[rule], symbols) if n else symbols), owner
            symbols, origin = spread(symbols, grow, 2 * rule, np.full(len(symbols), 2), flat)
            owner = owner[origin]

    right, owner = written(pairs[kept].ravel(), np.repeat(np.arange(len(kept)), 2))
    symbols, _ = written(seq, np.zeros(len(seq), np.int8))
    return Grammar(first, np.bincount(owner, minlength=len(kept)), right, lengths[kept], symbols)
