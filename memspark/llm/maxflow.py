"""Maximum flow by blocking flows on level graphs; the source side of the cut is what the source still reaches."""

from __future__ import annotations


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cut. gain: a node's terminal capacity, to the source if > 0, to the sink if < 0; edges: (a, b, capacity), both ways.

    Nodes that either side may have go to the sink.
    """
    n = len(gain)
    if not any(g > 0 for g in gain):
        return [False] * n
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        if c > 0:
            near[a].append(len(to))
            to.append(b)
            room.append(c)
            near[b].append(len(to))
            to.append(a)
            room.append(c)
    excess = [max(g, 0.0) for g in gain]
    drain = [max(-g, 0.0) for g in gain]
    eps = 1e-9
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if excess[v] > eps]
        for v in queue:
            level[v] = 0
        found = False
        for v in queue:  # grows while it is read
            if drain[v] > eps:
                found = True
                continue
            for e in near[v]:
                w = to[e]
                if room[e] > eps and level[w] < 0:
                    level[w] = level[v] + 1
                    queue.append(w)
        if not found:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in [v for v in queue if level[v] == 0]:
            path: list[int] = []
            v = s
            while excess[s] > eps:
                if drain[v] > eps:
                    f = min([excess[s], drain[v], *(room[e] for e in path)])
                    excess[s] -= f
                    drain[v] -= f
                    for e in path:
                        room[e] -= f
                        room[e ^ 1] += f
                    path, v = [], s
                    continue
                while at[v] < len(near[v]):
                    e = near[v][at[v]]
                    if room[e] > eps and level[to[e]] == level[v] + 1:
                        break
                    at[v] += 1
                if at[v] < len(near[v]):
                    path.append(near[v][at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
