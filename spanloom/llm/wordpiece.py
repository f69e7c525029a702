"""Token counts: greedy longest-match word pieces by a linear automaton (Aho-Corasick-like failure links).

The vocabulary's initial and continuation pieces are two tries.  Each node has a failure link to the node that
stands for the rest of its string after the longest pieces are taken off, and the *number* of pieces so taken
is precomputed, so a word's piece count is found in one pass over its characters, with no back-tracking and no
piece strings.  A word that cannot be covered counts as one unknown token, as in the usual word-piece model.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_kernel import text_chunks, word_hashes, word_spans

#: Fixed value: the mark that opens a word's first piece in the vocabulary file.
WORD_MARK = "▁"
CHUNK = 4 << 20


class LongestMatch:
    """Counts of greedy pieces; -1 for a word that the vocabulary cannot cover."""

    def __init__(self, initial: Iterable[str], continuation: Iterable[str]):
        self.go: list[dict[str, int]] = [{}, {}]  # node 0: start of a word, node 1: after a piece
        piece = [False, False]
        parents: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, words in ((0, initial), (1, continuation)):
            for w in words:
                node = root
                for c in w:
                    if c not in self.go[node]:
                        self.go[node][c] = len(self.go)
                        self.go.append({})
                        piece.append(False)
                        parents.append((node, c))
                    node = self.go[node][c]
                piece[node] = piece[node] or node > 1
        n = len(self.go)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([*self.go[0].values(), *self.go[1].values()])
        while todo:  # breadth first: links lead to shorter rests
            v = todo.popleft()
            todo.extend(self.go[v].values())
            if piece[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            u, c = parents[v]
            z, k = self.fail[u], self.popped[u]
            while z >= 0 and c not in self.go[z]:
                k += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.go[z][c], k

    def count(self, word: str) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            to = go[node].get(c)
            while to is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = go[node].get(c)
            node = to
        while node > 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


def load_pieces(model_file: str) -> tuple[list[str], list[str]]:
    """Initial and continuation pieces of a sentence-piece vocabulary, without its control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in ids]
    return [p[1:] for p in pieces if p[0] == WORD_MARK and len(p) > 1], [p for p in pieces if p[0] != WORD_MARK]


def token_counts(docs: DataFrame, initial: list[str], continuation: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row; words are maximal runs outside ASCII white space, A-Z lower.

    Null and empty texts have zeros; texts and words of any length are read whole; repeated rows and null ids are
    rows like others; other columns, whatever their names, are not read.  The vocabulary (its size is the file's, whatever the corpus) goes to each
    worker once; only a chunk's distinct words are run.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast((initial, continuation))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(*vocabulary.value)
        upper = {k: k + 32 for k in range(65, 91)}
        with np.errstate(over="ignore"):
            for batch in batches:
                for row, raw, offsets in text_chunks(batch["text"], CHUNK):
                    starts, ends, first = word_spans(raw, offsets)
                    _, at, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                    data = raw.tobytes()
                    each = np.fromiter((automaton.count(data[a:b].decode("utf-8", "replace").translate(upper)) for a, b in zip(starts[at], ends[at])), np.int64, len(at))
                    n = each[inverse] if len(at) else np.zeros(0, np.int64)
                    total = np.concatenate([[0], np.cumsum(np.abs(n))])
                    unknown = np.concatenate([[0], np.cumsum(n < 0)])
                    yield pa.record_batch({
                        "doc_id": batch["doc_id"].slice(row, len(first) - 1), "n_words": pa.array(np.diff(first)),
                        "n_tokens": pa.array(np.diff(total[first])), "n_unknown": pa.array(np.diff(unknown[first])),
                    })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_words long, n_tokens long, n_unknown long")
