"""Planar separators of at most 2 sqrt(2 n) vertices, one task for each graph.

Input is a combinatorial embedding: each vertex's neighbours in cyclic order. Levels of a BFS
tree give two small levels around the middle; where what lies between is still too heavy, a
fundamental cycle of the graph with the upper levels contracted splits it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FIRST, SECOND, SEPARATOR = 0, 1, 2


def _bfs(adj: dict, root) -> tuple[dict, dict]:
    level, parent, row = {root: 0}, {root: None}, [root]
    for u in row:
        for w in adj[u]:
            if w not in level:
                level[w], parent[w] = level[u] + 1, u
                row.append(w)
    return level, parent


def components(adj: dict) -> list[list]:
    seen, out = set(), []
    for v in adj:
        if v not in seen:
            part = list(_bfs(adj, v)[0])
            seen.update(part)
            out.append(part)
    return out


def _contracted(adj: dict, level: dict, parent: dict, root, top: int, bottom: int) -> dict:
    """The embedding of levels in (top, bottom) with a root that stands for all levels up to ``top`` (just the root itself for top < 0)."""
    inside = {v for v in adj if top < level[v] < bottom}
    if top < 0:
        return {v: [w for w in adj[v] if w in inside] for v in inside}
    ring, entry = [], {}
    # around the tree of contracted vertices, edges that leave it come in the order of the new root's rotation
    stack = [(root, 0, len(adj[root]), 0)]
    while stack:
        u, at, left, first = stack.pop()
        if left == 0:
            continue
        stack.append((u, (at + 1) % len(adj[u]), left - 1, first))
        w = adj[u][at]
        if level[w] <= top:
            if parent[w] == u and w not in entry:
                entry[w] = u
                stack.append((w, (adj[w].index(u) + 1) % len(adj[w]), len(adj[w]) - 1, 0))
        elif w in inside and w not in entry:
            entry[w] = u
            ring.append(w)
    new = {root: ring}
    for v in inside:
        new[v] = [root if w == entry.get(v) and level[w] <= top else w for w in adj[v] if w in inside or w == entry.get(v)]
    return new


def _faces(adj: dict) -> list[list]:
    at = {(v, w): i for v in adj for i, w in enumerate(adj[v])}
    seen, out = set(), []
    for start in at:
        if start in seen:
            continue
        face, edge = [], start
        while edge not in seen:
            seen.add(edge)
            face.append(edge[0])
            u, v = edge
            edge = (v, adj[v][(at[v, u] + 1) % len(adj[v])])
        out.append(face)
    return out


def _cycle(adj: dict, cost: dict, root) -> tuple[set, set]:
    """(cycle, inside) of the fundamental cycle that splits the cost most evenly. Faces are cut into triangles by chords from one corner."""
    _, parent = _bfs(adj, root)
    depth = {}
    for v in adj:
        chain = []
        while v is not None and v not in depth:
            chain.append(v)
            v = parent[v]
        d = depth[v] if v is not None else -1
        for x in reversed(chain):
            d += 1
            depth[x] = d
    triangles, owner = [], {}

    def side(u, v, t, chord=None):
        owner.setdefault((chord,) if chord is not None else (min(u, v), max(u, v)), []).append((t, u, v))

    chords = 0
    for face in _faces(adj):
        if len(face) < 3:
            t = len(triangles)
            triangles.append(tuple(face))
            for u, v in zip(face, face[1:] + face[:1], strict=True):
                side(u, v, t)
            continue
        last = None
        for i in range(1, len(face) - 1):
            t = len(triangles)
            triangles.append((face[0], face[i], face[i + 1]))
            if last is None:
                side(face[0], face[1], t)
            else:
                side(face[0], face[i], t, last)
            side(face[i], face[i + 1], t)
            if i == len(face) - 2:
                side(face[i + 1], face[0], t)
            else:
                last = f"c{chords}"
                chords += 1
                side(face[0], face[i + 1], t, last)
    dual: dict[int, list] = {t: [] for t in range(len(triangles))}
    for key, ends in owner.items():
        (t, u, v), *rest = ends
        if rest and not (len(key) == 2 and (parent[u] == v or parent[v] == u)):
            dual[t].append((rest[0][0], u, v))
            dual[rest[0][0]].append((t, u, v))
    order, up = [0], {0: None}
    for t in order:
        for s, u, v in dual[t]:
            if s not in up:
                up[s] = (t, u, v)
                order.append(s)
    # a vertex is inside a cycle if all its triangles are below the cycle's edge
    corners = {v: 0 for v in adj}
    for t in triangles:
        for v in set(t):
            corners[v] += 1
    below: dict[int, dict] = {t: {} for t in range(len(triangles))}
    total, best = sum(cost[v] for v in adj), None
    full: dict[int, float] = {}
    for t in reversed(order):
        count, heavy = below[t], full.get(t, 0.0)
        for v in set(triangles[t]):
            count[v] = count.get(v, 0) + 1
            if count[v] == corners[v]:
                heavy += cost[v]
                del count[v]
                count[v] = -1 << 60
        full[t] = heavy
        if up[t] is None:
            break
        s, u, v = up[t]
        loop, a, b = set(), u, v
        while a != b:
            if depth[a] >= depth[b]:
                loop.add(a)
                a = parent[a]
            else:
                loop.add(b)
                b = parent[b]
        loop.add(a)
        ring = sum(cost[x] for x in loop)
        within = heavy - sum(cost[x] for x in loop if count.get(x, 0) < 0)
        worst = max(within, total - within - ring)
        if best is None or worst < best[0]:
            best = (worst, loop, t)
        into = below[s]
        if len(into) < len(count):
            below[s] = into = _merged(count, into)
        else:
            _merged(into, count)
        done = [x for x, c in into.items() if c >= corners[x]]
        full[s] = full.get(s, 0.0) + heavy + sum(cost[x] for x in done)
        for x in done:
            into[x] = -1 << 60
        below[t] = {}
    if best is None:
        return {root}, set()
    _, loop, t = best
    member, row = {t}, [t]
    for x in row:
        for s, *_ in dual[x]:
            if up[s] is not None and up[s][0] == x and s not in member:
                member.add(s)
                row.append(s)
    held: dict = {}
    for x in member:
        for v in set(triangles[x]):
            held[v] = held.get(v, 0) + 1
    return loop, {v for v, c in held.items() if c == corners[v] and v not in loop}


def _merged(into: dict, other: dict) -> dict:
    for v, c in other.items():
        into[v] = min(into.get(v, 0), c) if c < 0 or into.get(v, 0) < 0 else into.get(v, 0) + c
    return into


def separate(adj: dict, cost: dict | None = None) -> dict:
    """part of each vertex: 0 and 1 of at most two thirds of the cost each and without an edge between, 2 the separator; part 0 is not the lighter one."""
    n = len(adj)
    cost = cost or dict.fromkeys(adj, 1.0)
    total = sum(cost.values()) or 1.0
    weight = lambda part: sum(cost[v] for v in part)
    pieces, cut = sorted(components(adj), key=weight, reverse=True), set()
    if pieces and weight(pieces[0]) > 2 * total / 3:
        big = {v: adj[v] for v in pieces[0]}
        root = next(iter(big))
        level, parent = _bfs(big, root)
        depth = max(level.values())
        rows = [[] for _ in range(depth + 1)]
        for v, l in level.items():
            rows[l].append(v)
        upto, middle, k = 0.0, 0, 0
        for l, row in enumerate(rows):
            upto, k = upto + weight(row), k + len(row)
            if upto > total / 2 or l == depth:
                middle = l
                break
        size = lambda l: len(rows[l]) if 0 <= l <= depth else 0
        top = next((l for l in range(middle, -1, -1) if size(l) + 2 * (middle - l) <= 2 * math.sqrt(k)), -1)
        bottom = next((l for l in range(middle + 1, depth + 2) if size(l) + 2 * (l - middle - 1) <= 2 * math.sqrt(n - k)), depth + 1)
        cut = {v for l in (top, bottom) if 0 <= l <= depth for v in rows[l]}
        between = {v for v in big if top < level[v] < bottom}
        parts = [[v for v in big if level[v] < top], [v for v in big if level[v] > bottom]]
        if weight(between) <= 2 * total / 3:
            parts.append(list(between))
        else:
            shrunk = _contracted(big, level, parent, root, top, bottom)
            loop, inside = _cycle(shrunk, {v: cost[v] if v in between else 0.0 for v in shrunk}, root)
            cut |= loop & between
            parts += [[v for v in between if v in inside and v not in loop], [v for v in between if v not in inside and v not in loop]]
        pieces = pieces[1:] + parts
    sides: list[list] = [[], []]
    for piece in sorted(pieces, key=weight, reverse=True):
        sides[weight(sides[0]) > weight(sides[1])].extend(piece)
    if weight(sides[1]) > weight(sides[0]):
        sides.reverse()
    out = dict.fromkeys(sides[0], FIRST) | dict.fromkeys(sides[1], SECOND)
    return out | dict.fromkeys(cut, SEPARATOR)


def label(lists: DataFrame) -> DataFrame:
    """(g, v, part) of embeddings (g, v, adj ARRAY in cyclic order, cost)."""

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v")
        adj = {int(v): [int(w) for w in a] for v, a in zip(part["v"], part["adj"], strict=True)}
        got = separate(adj, dict(zip(adj, part["cost"].astype(float), strict=True)))
        return pd.DataFrame({"g": key[0], "v": list(got), "part": np.array(list(got.values()), np.int32)})

    return lists.select("g", "v", "adj", "cost").groupBy("g").applyInPandas(one, "g long, v long, part int")


def grid_embedding(width: int, height: int) -> dict:
    """A w x h lattice with one diagonal in each cell, neighbours in cyclic order."""
    steps = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
    return {y * width + x: [(y + b) * width + x + a for a, b in steps if 0 <= x + a < width and 0 <= y + b < height] for y in range(height) for x in range(width)}


def random_planar(size: int, density: float = 1.0, seed: int = 0) -> dict:
    """A random embedding: a stacked triangulation with part of its edges taken out."""
    rng = np.random.default_rng(seed)
    adj: dict = {0: [1, 2], 1: [2, 0], 2: [0, 1]}
    faces = [(0, 1, 2), (0, 2, 1)]
    for v in range(3, size):
        a, b, c = faces.pop(int(rng.integers(len(faces))))
        for x, y in ((a, c), (b, a), (c, b)):  # the new vertex comes after y in x's order
            adj[x].insert(adj[x].index(y) + 1, v)
        adj[v] = [c, b, a]
        faces += [(a, b, v), (b, c, v), (c, a, v)]
    gone = [(u, w) for u in adj for w in adj[u] if u < w and rng.uniform() > density]
    for u, w in gone:
        adj[u].remove(w)
        adj[w].remove(u)
    return adj
