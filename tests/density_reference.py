"""The density clusters from their definition, in plain Python: all edges, a dendrogram, a condensed tree."""
import math

import numpy as np


def kruskal(pts, min_samples, ids=None):
    """``{(a, b): w}``: the spanning tree under the order (w, a, b)."""
    ids = list(range(len(pts))) if ids is None else ids
    if not len(pts):
        return {}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples, len(pts)) - 1]
    edges = sorted((max(core[i], core[j], d[i, j]), min(ids[i], ids[j]), max(ids[i], ids[j]), i, j)
                   for i in range(len(pts)) for j in range(i + 1, len(pts)))
    up = list(range(len(pts)))

    def root(u):
        while up[u] != u:
            up[u] = up[up[u]]
            u = up[u]
        return u
    tree = {}
    for w, a, b, i, j in edges:
        ri, rj = root(i), root(j)
        if ri != rj:
            up[ri] = rj
            tree[a, b] = w
    return tree


def labels_of(pts, min_cluster_size, min_samples):
    """Top down: the dendrogram's root first, splits with two large sides make clusters; then the best choice, and its labels."""
    n = len(pts)
    tree = sorted((w, a, b) for (a, b), w in kruskal(pts, min_samples).items())
    kids, members, node = {}, {i: [i] for i in range(n)}, {i: i for i in range(n)}
    for k, (w, a, b) in enumerate(tree, n):
        x, y = node[a], node[b]
        kids[k], members[k] = (x, y, w), members[x] + members[y]
        for p in members[k]:
            node[p] = k
    birth, sums, below, parts = {}, {}, {}, {}

    def walk(cluster, at):
        """Follow the cluster down from dendrogram node ``at``."""
        while True:
            if at < n:
                sums[cluster] += math.inf if len(members[at]) else 0
                return
            x, y, w = kids[at]
            lam = 1 / w if w > 0 else math.inf
            large = [c for c in (x, y) if len(members[c]) >= min_cluster_size]
            if len(large) == 2:
                sums[cluster] += lam * len(members[at])
                for c in large:
                    name = len(birth)
                    birth[name], sums[name], below[name], parts[name] = lam, 0.0, [], members[c]
                    below[cluster].append(name)
                    walk(name, c)
                return
            for c in (x, y):
                if c not in large:
                    sums[cluster] += lam * len(members[c])
            if not large:
                return
            at = large[0]
    out = [-1] * n
    if n < 2 or n < min_cluster_size:
        return out
    birth[0], sums[0], below[0], parts[0] = 0.0, 0.0, [], list(range(n))
    walk(0, 2 * n - 2)
    best, take = {}, {}
    for c in sorted(birth, reverse=True):
        own, sub = sums[c] - birth[c] * len(parts[c]), sum(best[k] for k in below[c])
        take[c] = not below[c] or own >= sub
        best[c] = max(own, sub) if below[c] else own
    taken, todo = [], list(below[0])
    while todo:
        c = todo.pop()
        if take[c]:
            taken.append(c)
        else:
            todo += below[c]
    for k, c in enumerate(sorted(taken, key=lambda c: min(parts[c]))):
        for p in parts[c]:
            out[p] = k
    return out
