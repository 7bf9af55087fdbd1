"""Operator 9: word-piece token counts by a linear longest-match automaton.

Greedy longest-match-first over a vocabulary takes the longest piece at each place of
a word. The automaton reads every byte once: where the trie has no edge, it pops the
pieces that are certain by now and follows the node's failure link into the trie of
later pieces. Only counts are wanted, so a node holds how many pieces its link pops,
not the pieces; none is ever built.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame, types as T

from shelflight.llm.common import blocks, id_and_text, map_arrow

# Entries of the word cache in a worker, and the longest word it keeps.
CACHE_WORDS = 600_000
CACHE_LENGTH = 64

# A word: bytes that are neither ASCII white space nor ASCII punctuation, or one
# punctuation sign (fixed value).
_WORD = re.compile(rb"[^\t-\r !-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]")


class Automaton:
    """Counts of the pieces that greedy longest match takes for a word.

    ``first`` are the pieces that may open a word, ``later`` those that may follow.
    """

    def __init__(self, first: set[bytes], later: set[bytes]):
        # nodes 0 and 1 are the roots of first and later pieces
        self.edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    below = self.edges[node].get(byte)
                    if below is None:
                        below = len(self.edges)
                        self.edges[node][byte] = below
                        self.edges.append({})
                        ends.append(False)
                    node = below
                if piece:
                    ends[node] = True
        self.link = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        level = [0, 1]
        while level:
            deeper = []
            for parent in level:
                for byte, node in self.edges[parent].items():
                    deeper.append(node)
                    if ends[node]:
                        self.link[node], self.popped[node] = 1, 1
                        continue
                    at, count = self.link[parent], self.popped[parent]
                    while at >= 0 and byte not in self.edges[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.edges[at][byte], count
            level = deeper

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if the vocabulary cannot spell it."""
        edges, link, popped = self.edges, self.link, self.popped
        node, total = 0, 0
        for byte in word:
            below = edges[node].get(byte)
            while below is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                below = edges[node].get(byte)
            node = below
        while node > 1:
            total += popped[node]
            node = link[node]
        return total if node == 1 else 0


@lru_cache(maxsize=2)
def automaton(rank_file: str) -> Automaton:
    """Pieces of a local rank file: a token with a leading space opens a word, one
    without may open or follow."""
    first, later = set(), set()
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" ":
                    first.add(token[1:])
                else:
                    first.add(token)
                    later.add(token)
    return Automaton(first - {b""}, later)


class Counter:
    """(words, pieces, unknown words) of a text; repeated words are counted once."""

    def __init__(self, machine: Automaton):
        self.machine = machine
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[int, int, int]:
        n_words = n_pieces = n_unknown = 0
        for block in blocks(text):
            words = _WORD.findall(block)
            new = set(words).difference(self.known)
            long = {w for w in new if len(w) > CACHE_LENGTH}
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = set(words)
            self.known.update((w, self.machine.count(w)) for w in new)
            counts = list(map(self.known.__getitem__, words))
            unknown = counts.count(0)
            n_words += len(words)
            n_pieces += sum(counts) + unknown
            n_unknown += unknown
            for word in long:
                self.known.pop(word, None)
        return n_words, n_pieces, n_unknown


def token_counts(
    docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text.

    A word that the vocabulary cannot spell is one unknown token. Null, empty and
    blank texts have 0 words. Repeated rows and null ids stay; an empty table gives
    no rows. ``rank_file`` is a path that every worker can open.
    """
    given = id_and_text(docs, id_col, text_col)
    numbers = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]
    schema = T.StructType([given.schema["doc_id"], *numbers])

    def start():
        count = Counter(automaton(rank_file))

        def step(batch):
            made = [count(t.as_py()) for t in batch.column("text")]
            return [batch.column("doc_id"), *(list(c) for c in zip(*made))] if made else [batch.column("doc_id"), [], [], []]

        return step

    return map_arrow(given, schema, start)
