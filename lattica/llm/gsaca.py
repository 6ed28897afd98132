"""Linear grouping suffix sorting, in lock-step over many short texts.

The construction (U. Baier, "Linear-time Suffix Sorting", CPM 2016) has two phases. First, suffixes are put into groups
that share a Lyndon prefix: groups are taken in descending order; each member's previous-smaller pointer is found, and
the suffixes that are pointed to move, by how often they are, into new groups right behind their old ones. Second, the
order inside the groups is emitted by walking the pointers from each suffix that is already in place; nothing is renamed
and nothing recurses.

Both phases are chains of dependent steps, so here one step is taken in every text of a batch at once: the n-th group
(or the n-th placement) of all texts is one set of numpy operations.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array of each text, one after another, as positions in the concatenation.

    text: all symbols (small non-negative integers); each text ends with its only 0. size: the texts' lengths."""
    n = len(text)
    base = np.cumsum(size) - size
    lane = np.repeat(np.arange(len(size)), size)
    code = lane * (int(text.max(initial=0)) + 1) + text
    order = np.argsort(code, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = code[order[1:]] != code[order[:-1]]
    first = np.flatnonzero(new)
    start = np.repeat(first, np.diff(np.append(first, n)))
    group = np.empty(n, np.int64)
    group[order] = start
    stop = np.zeros(n + 1, np.int64)
    stop[first] = np.append(first[1:], n)
    prev = _group(order, place, group, stop, base, size, lane)
    return _emit(group, prev, base, size)


def _group(order: np.ndarray, place: np.ndarray, group: np.ndarray, stop: np.ndarray, base: np.ndarray, size: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """First phase. order: suffixes by group; place: its inverse; group: the place where a suffix's group begins; stop:
    where the group beginning at a place ends. All are changed. Returns the pointers (-1: none)."""
    prev = np.full(len(order), -1, np.int64)
    marked = np.zeros(len(order), bool)
    floor = base[lane]
    top = base + size  # of each text: where the unprocessed groups end
    live = np.flatnonzero(top > base)
    while len(live):
        end = top[live]
        begin = group[order[end - 1]]
        count = end - begin
        if (count == 1).all():
            i = order[begin]
        else:
            i = order[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
        top[live] = begin
        live = live[begin > base[live]]
        own, low = group[i], floor[i]
        p = i - 1
        todo = np.flatnonzero((p >= low) & (group[p] > own))
        while len(todo):  # over suffixes of higher groups, whose pointers are known
            q = prev[p[todo]]
            p[todo] = q
            todo = todo[(q >= low[todo]) & (group[q] > own[todo])]
        p[p < low] = -1
        prev[i] = p
        same = np.flatnonzero((p >= 0) & (group[p] == own))
        while len(same):  # over members of the group itself, by doubling
            at = i[same]
            prev[at] = q = prev[prev[at]]
            same = same[(q >= 0) & (group[q] == own[same])]
        p = prev[i]
        p = p[p >= 0]
        if not len(p):
            continue
        p, times = np.unique(p, return_counts=True)
        old = group[p]
        by = np.lexsort((times, old))
        p, times, old = p[by], times[by], old[by]
        m = len(p)
        head = np.ones(m, bool)
        head[1:] = old[1:] != old[:-1]
        head_at = np.flatnonzero(head)
        moved = np.diff(np.append(head_at, m))
        tail = np.repeat(stop[old[head_at]] - moved, moved)  # where the moved part of the old group begins
        to = tail + np.arange(m) - np.repeat(head_at, moved)
        marked[p] = True
        there = order[to]
        there = there[~marked[there]]
        hole = place[p]
        hole = hole[hole < tail]
        marked[p] = False
        order[hole], place[there] = there, hole
        order[to], place[p] = p, to
        stop[old[head_at]] = tail[head_at]
        head[1:] |= times[1:] != times[:-1]
        head_at = np.flatnonzero(head)
        group[p] = np.repeat(to[head_at], np.diff(np.append(head_at, m)))
        last = np.append(head_at[1:], m) - 1
        stop[to[head_at]] = to[last] + 1
    return prev


def _emit(group: np.ndarray, prev: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Second phase: every text places or passes one suffix a step."""
    n = len(group)
    out = np.full(n, -1, np.int64)
    free = np.arange(n + 1)  # of each group, by where it begins: its next free place
    placed = np.zeros(n + 1, bool)
    placed[n] = True  # stands for "no suffix"
    alive = size > 0
    base, end = base[alive], (base + size)[alive]
    out[base] = end - 1
    placed[end - 1] = True
    at, low = base.copy(), base
    j = np.where(out[at] > low, out[at] - 1, n)
    while len(at):
        done = placed[j]
        go = ~done
        jj = j[go]
        g = group[jj]
        out[free[g]] = jj
        free[g] += 1
        placed[jj] = True
        q = prev[jj]
        q[q < 0] = n
        j[go] = q
        if done.any():
            at = at + done
            left = at < end
            if not left.all():
                at, low, end, j, done = at[left], low[left], end[left], j[left], done[left]
            s = out[at[done]]
            j[done] = np.where(s > low[done], s - 1, n)
    return out
