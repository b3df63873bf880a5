"""Token counts by a linear longest-match automaton.

The vocabulary is a set of byte strings. Greedy longest match cuts a word into the longest entry that its
rest begins with, again and again. The automaton is the trie of the vocabulary with failure links: where a
node has no child for the next byte, the entries that greedy matching would give out at that point are popped,
and matching goes on at the node for what is left. The link of a node holds the number of popped entries and
that node, computed once, so that a word is read once from left to right and only numbers are added; no pieces
are built. A word that the vocabulary cannot spell counts as one unknown token.

Words are [^\\x20\\x09-\\x0D]+ of the whole text; each is matched as `prefix` + word. Null and empty texts have
0 words and 0 tokens; repeated rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words whose counts a task remembers before it starts afresh.
REMEMBERED = 500_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Automaton:
    """Trie edges in one dictionary keyed by 256 * node + byte; per node the failure node and its popped count."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        entry = [False]
        parent, last = [0], [0]
        for word in vocabulary:
            node = 0
            for byte in word:
                key = 256 * node + byte
                child = self.edges.get(key)
                if child is None:
                    child = self.edges[key] = len(entry)
                    entry.append(False)
                    parent.append(node)
                    last.append(byte)
                node = child
            if node:
                entry[node] = True
        # Breadth first: the failure of a node follows from that of its parent. -1 stands for no failure.
        self.failure, self.popped = [-1] * len(entry), [0] * len(entry)
        depth = [0] * len(entry)
        for node in range(1, len(entry)):
            depth[node] = depth[parent[node]] + 1
        for node in sorted(range(1, len(entry)), key=depth.__getitem__):
            if entry[node]:
                self.failure[node], self.popped[node] = 0, 1
                continue
            at, popped = self.failure[parent[node]], self.popped[parent[node]]
            while at >= 0:
                child = self.edges.get(256 * at + last[node])
                if child is not None:
                    self.failure[node], self.popped[node] = child, popped
                    break
                popped += self.popped[at]
                at = self.failure[at]

    def count(self, word: bytes) -> int:
        """Entries of the greedy longest match; 1 if the vocabulary cannot spell the word, 0 for an empty one."""
        edges, failure, popped = self.edges, self.failure, self.popped
        node = total = 0
        for byte in word:
            child = edges.get(256 * node + byte)
            while child is None:
                total += popped[node]
                node = failure[node]
                if node < 0:
                    return 1
                child = edges.get(256 * node + byte)
            node = child
        while node:
            total += popped[node]
            node = failure[node]
            if node < 0:
                return 1
        return total


def rank_file(path: str) -> list[bytes]:
    """Entries of a vocabulary file with one base64 string and its rank per line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(docs: DataFrame, vocabulary: str, prefix: bytes = b" ") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_tokens; vocabulary: path of a rank file on every executor."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = None, {}
        for batch in batches:
            automaton = automaton or Automaton(rank_file(vocabulary))
            words, tokens = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = _WORD.findall(text)
                for word in set(found).difference(known):
                    known[word] = automaton.count(prefix + word)
                words.append(len(found))
                tokens.append(sum([known[w] for w in found]))
                if len(known) > REMEMBERED:
                    known = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
