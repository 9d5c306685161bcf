"""Token counts of greedy word-piece encoding by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces
that continue one (written ``##piece``).  Each node has a failure link and the
number of tokens popped when it is taken: when the walk cannot go on from a
node, the longest matches inside the text read so far are fixed, so only their
number is stored and no piece is ever built.  Every character moves the walk
forward once and every failure pops a token at least, so a word takes time
linear in its length, however long it is.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  A word with no full cover counts as
one unknown token.  Null and empty texts have no words.  Repeated rows are
counted each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .chunks import Cache, split_chunks
from .common import require_columns, text_slices, worker_state

CONTINUES = "##"


class LongestMatch:
    """Trie, failure links and popped-token counts of one vocabulary."""

    BEGIN, GO_ON = 0, 1

    def __init__(self, vocabulary):
        self.children = [{}, {}]
        whole = [False, False]
        for piece in vocabulary:
            node = self.GO_ON if piece.startswith(CONTINUES) else self.BEGIN
            body = piece.removeprefix(CONTINUES)
            for letter in body:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                node = nxt
            if body:
                whole[node] = True
        self.fail = [None] * len(self.children)
        self.pops = [0] * len(self.children)
        level = [self.BEGIN, self.GO_ON]
        while level:
            deeper = []
            for parent in level:
                for letter, node in self.children[parent].items():
                    deeper.append(node)
                    if whole[node]:
                        self.fail[node], self.pops[node] = self.GO_ON, 1
                        continue
                    at, popped = self.fail[parent], self.pops[parent]
                    while at is not None and letter not in self.children[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[node], self.pops[node] = self.children[at][letter], popped
            level = deeper

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces; 0 if the word cannot be covered."""
        children, fail, pops = self.children, self.fail, self.pops
        node, n = self.BEGIN, 0
        for letter in word:
            while (nxt := children[node].get(letter)) is None:
                n += pops[node]
                node = fail[node]
                if node is None:
                    return 0
            node = nxt
        while node != self.GO_ON:
            n += pops[node]
            node = fail[node]
            if node is None:
                return 0
        return n


def count_tokens(docs: DataFrame, vocabulary, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns with n_words, n_tokens (an unknown word is one), n_unknown per row.

    The vocabulary is a tokenizer's list of pieces (tens of thousands), broadcast
    as one string.
    """
    require_columns(docs, text, *keep)
    packed = json.dumps(list(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    width = len(keep)

    def build():
        return LongestMatch(json.loads(shared.value)), Cache()

    def run(batches):
        import pyarrow as pa
        automaton, seen = worker_state(("wordpiece", hashlib.sha256(shared.value.encode()).digest()), build)
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                codes, chunks, offsets = split_chunks(batch.column(width))
                counts = []
                for chunk in chunks:
                    n = seen.get(chunk)
                    if n is None:
                        n = seen.put(chunk, automaton.count(chunk) if chunk else -1)
                    counts.append(n)
                counts = np.array(counts, np.int64)[codes] if len(codes) else np.empty(0, np.int64)
                sums = [np.concatenate(([0], np.cumsum(x)))[offsets] for x in
                        (counts >= 0, np.where(counts > 0, counts, counts == 0), counts == 0)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(width)), *(pa.array(np.diff(s).astype(np.int64)) for s in sums)],
                    names=[*keep, "n_words", "n_tokens", "n_unknown"])

    return (docs.select(*keep, F.col(text).alias("_text"))
                .mapInArrow(run, f"{kept}, n_words long, n_tokens long, n_unknown long"))
