"""Deep-shallow suffix sorting (Manzini and Ferragina 2004), as far as a given depth.

Shallow: three-way multikey quicksort over characters of eight bytes, down to `shallow` bytes.
Deep: groups that still tie share a long prefix; a blind trie, which looks only at the bytes where its strings branch and
compares one string in full an insertion, orders what is left of each.
"""

from __future__ import annotations

import numpy as np


class BlindTrie:
    """Orders byte strings of equal length. A node is [byte place, {byte: child}, leaf]; a leaf is [None, string, members]."""

    def __init__(self):
        self.top = None

    def add(self, s: bytes, member: int) -> None:
        if self.top is None:
            self.top = [None, s, [member]]
            return
        node = self.top  # blind: only branching bytes are looked at
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        found = node[1]
        if found == s:
            node[2].append(member)
            return
        at = next(i for i, (a, b) in enumerate(zip(found, s)) if a != b)
        parent, node = None, self.top  # again from the top, down to where the strings part
        while node[0] is not None and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        leaf = [None, s, [member]]
        if node[0] == at:
            node[1][s[at]] = leaf
            return
        branch = [at, {found[at]: node, s[at]: leaf}, None]
        if parent is None:
            self.top = branch
        else:
            parent[1][s[parent[0]]] = branch

    def groups(self):
        """Members of each different string, in order."""
        stack = [self.top] if self.top else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def _three_ways(keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, less, equal): where each key of consecutive segments goes when every segment is split around a pivot of its own (the
    median of its first, middle and last key), and how many keys of each are less than and equal to it. The order within the three
    parts stays."""
    ends = np.stack([keys[first], keys[first + size // 2], keys[first + size - 1]])
    pivot = np.repeat(np.sort(ends, axis=0)[1], size)
    at = np.repeat(first, size)
    less, same = keys < pivot, keys == pivot
    n_less, n_same = (np.add.reduceat(x.astype(np.int64), first) for x in (less, same))

    def number(mask):  # of each marked key among the marked ones of its segment
        run = np.cumsum(mask)
        return run - mask - np.repeat(run[first] - mask[first], size)

    more = ~(less | same)
    place = np.where(less, number(less), np.where(same, np.repeat(n_less, size) + number(same), np.repeat(n_less + n_same, size) + number(more)))
    return at + place, n_less, n_same


def multikey(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the starts by the `depth` bytes that follow each (a multiple of eight), and the places at which groups of equal
    ones begin.

    Multikey quicksort (Bentley and Sedgewick 1997) over characters of eight bytes, cached while a segment stays at its depth: around
    a pivot, the equal part goes on with the next character, the other two with the same one. All open segments are split together."""
    n = len(starts)
    order, begins = np.arange(n), np.zeros(n, bool)
    begins[:1] = True
    first, size, d = np.zeros(1, np.int64), np.full(1, n, np.int64), np.zeros(1, np.int64)
    keys = words[starts].astype(np.uint64)
    while len(first):
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        own = np.cumsum(size) - size
        place, less, same = _three_ways(keys, own, size)
        moved, cached = np.empty(len(at), np.int64), np.empty(len(at), np.uint64)
        moved[place], cached[place] = order[at], keys
        order[at] = moved
        cut = np.stack([np.zeros_like(less), less, less + same], axis=1)
        lens = np.stack([less, same, size - less - same], axis=1)
        begins[(first[:, None] + cut)[lens > 0]] = True
        deeper = np.stack([d, d + 8, d], axis=1)
        go = (lens > 1) & (deeper < depth)
        first, old, size, d, grown = (first[:, None] + cut)[go], (own[:, None] + cut)[go], lens[go], deeper[go], np.broadcast_to([False, True, False], go.shape)[go]
        take = np.repeat(old - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        keys = cached[take]
        fresh = np.repeat(grown, size)
        keys[fresh] = words[starts[moved[take[fresh]]] + np.repeat(d, size)[fresh]]
    return order, np.flatnonzero(begins)


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the starts by the `depth` bytes that follow each, and for each place in that order the number of its
    group of equal strings, ascending. data: bytes (uint8) with at least depth + 8 bytes from each start on."""
    n = len(starts)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    shallow = min(shallow, depth - depth % 8)
    order, first = multikey(np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)), starts, shallow)
    cuts = np.zeros(n, np.int64)
    cuts[first[1:]] = 1
    if depth > shallow:
        size = np.diff(np.concatenate([first, [n]]))
        tails = np.lib.stride_tricks.sliding_window_view(data, depth - shallow)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        head = np.repeat(first, size)[tied]
        differs = np.zeros(len(tied), bool)
        for a in range(0, len(tied), 1 << 20):
            b = slice(a, a + (1 << 20))
            differs[b] = (tails[starts[order[tied[b]]] + shallow] != tails[starts[order[head[b]]] + shallow]).any(axis=1)
        for f in np.unique(head[differs]).tolist():  # the others are all equal to their first
            g = int(np.searchsorted(first, f))
            trie = BlindTrie()
            for m in order[f : f + size[g]].tolist():
                s = int(starts[m]) + shallow
                trie.add(data[s : s + depth - shallow].tobytes(), m)
            at = f
            for members in trie.groups():
                order[at : at + len(members)] = members
                if at > f:
                    cuts[at] = 1
                at += len(members)
    return order, np.cumsum(cuts)
