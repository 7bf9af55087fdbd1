"""Burkhard-Keller trees over 64-bit codes, built and asked in whole arrays."""

from __future__ import annotations

import numpy as np

# Subtrees of at most this many codes stay a flat leaf.
LEAF = 48
# Codes asked at once; bounds the distance arrays of a leaf.
ASK = 1024


class BKTree:
    """Each node holds one code; its children are keyed by the integer Hamming
    distance of everything below them to that code. By the triangle inequality a
    question of radius r at distance d from a node follows only the edges
    d - r to d + r."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.root = self._build(np.arange(len(codes)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        pivot, rest = rows[0], rows[1:]
        far = np.bitwise_count(self.codes[rest] ^ self.codes[pivot])
        order = np.argsort(far, kind="stable")
        edges, starts = np.unique(far[order], return_index=True)
        below = np.split(rest[order], starts[1:])
        if len(edges) == 1 and edges[0] == 0:  # equal codes do not split
            return rows
        return pivot, edges.astype(np.int64), [self._build(part) for part in below]

    def visit(self, asked: np.ndarray, radius: int, found) -> None:
        """Calls ``found(questions, rows, near)`` for each node or leaf reached:
        ``near[i, j]`` tells whether rows[j] is within the radius of questions[i]."""
        for at in range(0, len(asked), ASK):
            stack = [(self.root, np.arange(at, min(at + ASK, len(asked))))]
            while stack:
                node, who = stack.pop()
                if isinstance(node, np.ndarray):
                    if len(node):
                        apart = np.bitwise_count(asked[who][:, None] ^ self.codes[node][None, :])
                        found(who, node, apart <= radius)
                    continue
                pivot, edges, children = node
                apart = np.bitwise_count(asked[who] ^ self.codes[pivot]).astype(np.int64)
                found(who, np.array([pivot]), (apart <= radius)[:, None])
                for edge, child in zip(edges, children):
                    near = who[np.abs(apart - edge) <= radius]
                    if len(near):
                        stack.append((child, near))

    def degree(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Number of codes within the radius of each asked code."""
        count = np.zeros(len(asked), np.int64)

        def found(who, _, near):
            count[who] += near.sum(axis=1)

        self.visit(asked, radius, found)
        return count

    def near_any(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Mask of the tree's codes within the radius of any asked code."""
        hit = np.zeros(len(self.codes), bool)

        def found(_, rows, near):
            hit[rows[near.any(axis=0)]] = True

        self.visit(asked, radius, found)
        return hit


def spanning_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, representative): links that join exactly the codes which chains of
    neighbours within ``radius`` join; no link for a code without neighbours.

    Components are flooded through the tree: every code is asked twice at most,
    and no pair is ever listed.
    """
    tree = BKTree(codes)
    rows = np.flatnonzero(tree.degree(codes, radius) > 1)
    if not len(rows):
        return codes[:0], codes[:0]
    codes = codes[rows]
    tree = BKTree(codes)
    root = np.full(len(codes), -1)
    for seed in range(len(codes)):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        edge = np.array([seed])
        while len(edge):
            edge = np.flatnonzero(tree.near_any(codes[edge], radius) & (root < 0))
            root[edge] = seed
    linked = np.flatnonzero(root != np.arange(len(codes)))
    return codes[linked], codes[root[linked]]
