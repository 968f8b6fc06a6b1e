"""Word-piece counts with a linear longest-match automaton.

The vocabulary's trie has failure links, and each node holds how many pieces the greedy
longest-match-first rule pops on its failure. A word is read once, byte by byte; pieces are never
built. The vocabulary file is read on the driver; its path is a parameter.

Words are runs of non-white-space (\\x20 \\x09-\\x0D part them), and a word begins with a space mark,
as pieces at a word's beginning do. A word that cannot be cut counts as one unknown piece.

Defined results: null, empty and blank texts have 0 words and 0 tokens; repeated rows come back as
often; an empty table gives no rows; very long words are read once like any other; extra columns
are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Vocabulary files larger than this are refused: the automaton is sent to every task.
MOST_BYTES = 64 << 20
_MEMO_WORDS, _MEMO_BYTES = 200_000, 64


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("the vocabulary is too large")
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


class Automaton:
    """next: {node * 256 + byte: node}; link: failure node or -1; popped: pieces popped on failure."""

    memo: _Memo | None = None  # made in the task, and gone with the automaton

    def __init__(self, pieces: list[bytes]) -> None:
        self.next: dict[int, int] = {}
        ends, parent, by = [False], [-1], [0]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node * 256 + byte
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(ends)
                    ends.append(False)
                    parent.append(node)
                    by.append(byte)
                node = child
            ends[node] = True
        n = len(ends)
        self.link, self.popped = np.full(n, -1, np.int32).tolist(), np.zeros(n, np.int32).tolist()
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, n), key=depth.__getitem__):
            if ends[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            at, count = self.link[parent[v]], self.popped[parent[v]]
            while at >= 0 and at * 256 + by[v] not in self.next:
                count += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.popped[v] = self.next[at * 256 + by[v]], count

    def count(self, word: bytes) -> int:
        """Pieces of one word, its mark included; 1 if it cannot be cut."""
        step, link, popped = self.next, self.link, self.popped
        node = pieces = 0
        for byte in word:
            while (to := step.get(node * 256 + byte)) is None:
                if link[node] < 0:
                    return 1
                pieces += popped[node]
                node = link[node]
            node = to
        while node:
            if link[node] < 0:
                return 1
            pieces += popped[node]
            node = link[node]
        return pieces


class _Memo(dict):
    """Counts of short words met before; bounded."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= _MEMO_BYTES:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def count_texts(texts: list[str | None], automaton: Automaton) -> tuple[list[int], list[int]]:
    """Words and tokens of each text."""
    memo = automaton.memo = automaton.memo or _Memo(automaton)
    n_words, n_tokens = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n_words.append(len(words))
        n_tokens.append(sum(map(memo.__getitem__, words)))
    return n_words, n_tokens


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))

    @F.pandas_udf("n_words long, n_tokens long")
    def of(texts: pd.Series) -> pd.DataFrame:
        n_words, n_tokens = count_texts(list(texts), sent.value)
        return pd.DataFrame({"n_words": n_words, "n_tokens": n_tokens}, dtype="int64")

    counted: Column = of(F.col(text_col)).alias("c")
    return docs.select(F.col(id_col).alias("doc_id"), counted).select("doc_id", "c.n_words", "c.n_tokens")
