"""Plain cell-by-cell versions of the operators, to test against."""

from __future__ import annotations

import numpy as np


def smith_waterman(la, lb, ra, rb, wa, wb, p):
    """(a range, b range, pairs, lemma, sub, root-only, gaps, score, weight sum, unique) or None."""
    n, m = len(la), len(lb)
    if not n or not m:
        return None

    def score(i, j):
        root = ra[i] == rb[j] and ra[i] != 0
        if p.mode == "root":
            return p.lemma_score if root else p.mismatch_penalty
        if la[i] == lb[j]:
            return int(np.float32(p.lemma_score) * np.float32(min(wa[i], wb[j]))) if wa is not None else p.lemma_score
        return p.root_score if p.mode == "combined" and root else p.mismatch_penalty

    h = [[0] * (m + 1) for _ in range(n + 1)]
    best = (0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + score(i - 1, j - 1), h[i - 1][j] + p.gap_penalty, h[i][j - 1] + p.gap_penalty)
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    top, i, j = best
    if top < int(p.min_length * p.lemma_score / 2):
        return None
    pairs, gaps = [], 0
    while i > 0 and j > 0 and h[i][j] > 0:
        if h[i][j] == h[i - 1][j - 1] + score(i - 1, j - 1):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif h[i][j] == h[i - 1][j] + p.gap_penalty:
            i, gaps = i - 1, gaps + 1
        else:
            j, gaps = j - 1, gaps + 1
    if len(pairs) < p.min_length or not pairs:
        return None
    lemma = [q for q in pairs if la[q[0]] == lb[q[1]]]
    root = [q for q in pairs if la[q[0]] != lb[q[1]] and ra[q[0]] == rb[q[1]] != 0]
    like = {"lemma": len(lemma), "root": sum(ra[a] == rb[b] != 0 for a, b in pairs), "combined": len(lemma) + 0.5 * len(root)}[p.mode] / len(pairs)
    if np.float32(like) < np.float32(p.min_similarity):
        return None
    total = np.float32(0)
    for a, b in lemma if wa is not None else ():
        total = np.float32(total + min(np.float32(wa[a]), np.float32(wb[b])))
    return (pairs[-1][0], pairs[0][0] + 1, pairs[-1][1], pairs[0][1] + 1, len(pairs), len(lemma), len(pairs) - len(lemma) - len(root), len(root), gaps, top, float(total), len({la[a] for a, _ in lemma}))
