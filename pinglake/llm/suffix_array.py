"""Suffix arrays by linear grouping.

Phase one sorts suffixes into groups by their Lyndon prefix. Groups start as the first symbols and
are processed from the greatest down: each suffix of a group finds the nearest position before it
that is in a smaller group (its previous smaller pointer), and the positions so found move to new
groups right above their own, those reached more often going higher, since what follows them is
greater than what follows the rest. A processed group is final.

Phase two emits the order: the suffix that follows a Lyndon prefix decides the place inside the
group, so walking the array from its start, each entry's predecessors along the pointers that are
not placed yet take the next free places of their groups. No suffix is renamed and nothing recurs.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Starts of all suffixes of ``text`` in lexicographic order; an empty text has none."""
    n = len(text)
    if not n:
        return []
    # Groups in a doubly linked list; group 0 is a sentinel below all.
    symbols = sorted(set(text))
    of = {c: i + 1 for i, c in enumerate(symbols)}
    group = [of[c] for c in text]
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    above = list(range(1, len(symbols) + 2))
    below = list(range(-1, len(symbols)))
    top = len(symbols)
    above[top] = -1
    before = [-1] * n
    done = bytearray(n + 1)  # the last place stands for the start of the text and stays 0

    g = top
    while g > 0:
        if size[g]:
            # Those that moved on are still listed.
            mine = [s for s in members[g] if group[s] == g]
            mine.sort()
            for s in mine:
                done[s] = 1
            reached: dict[int, int] = {}
            most = 1
            for s in mine:
                p = s - 1
                while done[p]:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    if p in reached:
                        k = reached[p] = reached[p] + 1
                        if k > most:
                            most = k
                    else:
                        reached[p] = 1
            # Those reached most often go first, so that later ones end up below them.
            for level in range(most, 0, -1):
                here = reached if most == 1 else [p for p, k in reached.items() if k == level]
                moved: dict[int, list[int]] = {}
                for p in here:
                    moved.setdefault(group[p], []).append(p)
                for old, items in moved.items():
                    if len(items) == size[old]:
                        continue  # the whole group moves: its order stays as it is
                    new = len(members)
                    members.append(items)
                    size.append(len(items))
                    size[old] -= len(items)
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for p in items:
                        group[p] = new
        g = below[g]

    # Free places, group by group from the smallest.
    free = [0] * len(members)
    at = 0
    g = above[0] if symbols else -1
    while g >= 0:
        free[g] = at
        at += size[g]
        g = above[g]
    order = [-1] * n
    placed = bytearray(n + 1)
    placed[n] = 1  # index -1 ends a walk
    t = n
    for i in range(-1, n):
        if i >= 0:
            t = order[i]
        s = t - 1
        while not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return order
