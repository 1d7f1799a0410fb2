"""Plain forms that tests compare with."""

import re
from collections import deque

import numpy as np
import xxhash

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    w = WORD.findall((text or "").translate(str.maketrans(UP, LOW)))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits=4):
    """Smallest index reachable, of each fingerprint."""
    v = np.array(fps, np.uint64)
    label = list(range(len(v)))
    for start in range(len(v)):
        if label[start] < start:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(np.bitwise_count(v ^ v[x]) <= max_bits).tolist():
                if label[y] > start:
                    label[y] = start
                    todo.append(y)
    return label


def targets(sizes, weights, cap=3.0):
    """Share sum(sizes) by weight; a target stops at cap times its size and the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            open_.discard(i)
        left = max(0.0, float(sum(sizes)) - sum(out))
    return out


def cheapest_flow(sizes, members, quotas, repeat=3):
    """(flow, cost) of the cheapest largest flow, by shortest paths one after the other."""
    arcs, out = [], {}

    def arc(a, b, cap, cost):
        for x, y, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([y, c, k])

    for p, n in sizes.items():
        for cost in range(repeat):
            arc("from", ("p", p), n, cost)
        for s in members[p]:
            arc(("p", p), ("s", s), repeat * n, 0)
    for s, q in quotas.items():
        arc(("s", s), "to", q, 0)
    sent = spent = 0
    while True:
        far, via, queue = {"from": 0}, {}, deque(["from"])
        while queue:
            a = queue.popleft()
            for e in out.get(a, []):
                b, cap, cost = arcs[e]
                if cap and far[a] + cost < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost, e
                    queue.append(b)
        if "to" not in far:
            return sent, spent
        path, at = [], "to"
        while at != "from":
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
        sent, spent = sent + push, spent + push * far["to"]


def shingle_set(text, words=5):
    w = WORD.findall((text or "").translate(str.maketrans(UP, LOW)))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) > words else frozenset([tuple(w)] if w else [])


def brute_similar(texts, least=0.8):
    """Smallest index reachable by pairs of that similarity, of each text."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and len(a & b) >= least * len(a | b)):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(sets))]
