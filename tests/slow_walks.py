"""Walks by plain Python on one component: what the operators are held against."""

from __future__ import annotations

import hashlib

import pandas as pd

from pairstrand.operators.decode import Strategy


class Component:
    """Edges of one component: adjacency with gains and prefix lengths, shrinking as walks are peeled off."""

    def __init__(self, rows: pd.DataFrame):
        self.out: dict[int, dict[int, tuple[float, int]]] = {}
        self.into: dict[int, set[int]] = {}
        self.length: dict[int, int] = {}
        for r in rows.sort_values(["src", "dst"]).itertuples():
            self.out.setdefault(r.src, {})[r.dst] = (r.gain, r.prefix_length)
            self.into.setdefault(r.dst, set()).add(r.src)
            self.length[r.src], self.length[r.dst] = r.src_length, r.dst_length

    def between(self, u: int, v: int) -> set[int]:
        return self.out.get(u, {}).keys() & self.into.get(v, set())

    def near(self, node: int) -> set[int]:
        return self.out.get(node, {}).keys() | self.into.get(node, set())

    def remove(self, nodes: set[int]) -> None:
        for x in nodes & self.length.keys():
            del self.length[x]
            for y in self.out.pop(x, {}):
                self.into[y].discard(x)
            for y in self.into.pop(x, set()):
                self.out.get(y, {}).pop(x, None)


def beam(g: Component, start: int, visited: frozenset[int], width: int, intermediate: bool = True, backward: bool = False) -> tuple[list[int], frozenset[int], float, int]:
    """Best walk from a node: path, visited nodes, total gain, sum of prefix lengths.

    Each state goes on to its best unvisited neighbours, at most ``width``; a state without any stays. Of states that end in
    one node the best is kept, and of all the ``width`` best. With ``intermediate`` a better state of an earlier round wins.
    """
    first = ((start,), visited | {start, start ^ 1}, 0.0, 0)
    states, best = [first], first
    while True:
        nxt: dict[int, tuple] = {}
        for state in states:
            path, seen, total, length = state
            here = path[-1]
            if backward:
                options = [(y, g.out[y][here]) for y in g.into.get(here, ()) if y not in seen]
            else:
                options = [(y, e) for y, e in g.out.get(here, {}).items() if y not in seen]
            grown = [state]
            if options:
                options.sort(key=lambda o: (-o[1][0], o[0]))
                grown = []
                for y, (gain, prefix) in options[:width]:
                    around = g.between(y, here) if backward else g.between(here, y)
                    grown.append(((*path, y), seen | {y, y ^ 1} | around | {x ^ 1 for x in around}, total + gain, length + prefix))
            for s in grown:
                old = nxt.get(s[0][-1])
                if old is None or s[2] > old[2]:
                    nxt[s[0][-1]] = s
        kept = sorted(nxt.values(), key=lambda s: (-s[2], s[0][-1]))[:width]
        if [s[0] for s in kept] == [s[0] for s in states]:
            break
        states = kept
        if states[0][2] > best[2]:
            best = states[0]
    final = max(states, key=lambda s: s[2])
    path, seen, total, length = best if intermediate and best[2] > final[2] else final
    return list(path), seen, total, length


def walk_through(g: Component, src: int, dst: int, s: Strategy) -> tuple[list[int], int]:
    """The walk through an edge: forward from its end, backward from its beginning on the other strand."""
    ahead, seen, _, _ = beam(g, dst, frozenset({src, src ^ 1}), s.beam_width, s.beam_intermediate)
    seen = frozenset(seen - {src, src ^ 1})
    if src ^ 1 in g.length:
        behind = [x ^ 1 for x in reversed(beam(g, src ^ 1, seen, s.beam_width, s.beam_intermediate)[0])]
    else:
        behind = list(reversed(beam(g, src, seen, s.beam_width, s.beam_intermediate, backward=True)[0]))
    path = behind + ahead
    steps = [(a, b) for a, b in zip(path[:-1], path[1:], strict=True)]
    total = sum(g.out[a][b][1] if b in g.out.get(a, {}) else g.length[a] for a, b in steps if a in g.length)
    return path, total + g.length[path[-1]]


def starts(g: Component, s: Strategy, seed: int = 0) -> list[tuple[int, int]]:
    """Sampled edges: the first by a hash, or those of the largest gains."""
    every = [(a, b) for a, ys in g.out.items() for b in ys]
    if s.sample_by_score:
        every.sort(key=lambda e: (-g.out[e[0]][e[1]][0], e))
    else:
        every.sort(key=lambda e: (hashlib.md5(f"{e[0]}-{e[1]}-{seed}".encode()).hexdigest(), e))
    return every[: s.sample_size]


def neighbourhood(g: Component, path: list[int], strategy: str) -> set[int]:
    """Nodes that a walk uses up, with their complements."""
    out = set(path)
    if strategy == "full_component":
        out = set(g.length)
    elif strategy == "shared_neighbors":
        for a, b in zip(path[:-1], path[1:], strict=True):
            out |= g.between(a, b)
    else:
        for _ in range({"1-hop": 1, "2-hop": 2}[strategy]):
            out |= {y for x in out for y in g.near(x)}
    return out | {x ^ 1 for x in out}


def find_paths(g: Component, s: Strategy) -> list[list[int]]:
    """Walks peeled off until what is left is too small or its best walk too short."""
    out = []
    while len(g.length) > s.min_path_length:
        best, best_length = None, -1
        for src, dst in starts(g, s, len(out)):
            path, length = walk_through(g, src, dst, s)
            if length > best_length:
                best, best_length = path, length
        if best is None or best_length < s.min_walk_length:
            break
        out.append(best)
        g.remove(neighbourhood(g, best, s.visited))
    return out
