"""Operator 3: token counts by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes carry a failure link and the number of
tokens popped when it is taken. One pass over a word's bytes counts the pieces of
greedy longest matching in time linear in its length; no piece is built.

A word is matched as its UTF-8 bytes after one space, as the vocabulary's
word-initial entries are written. A word that the vocabulary can't spell counts
as one unknown token. Null and blank texts have no words and no tokens. Repeated
rows are counted each; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices, words_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of each worker's memory of words: entries, and characters of a word.
REMEMBERED, WORD_CHARS = 300_000, 64
ROOT = 0


class LongestMatch:
    """The automaton over a vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        ends, byte_of, parent = [False], [0], [0]
        for token in vocabulary:
            at = ROOT
            for b in token:
                key = at << 8 | b
                if key not in self.step:
                    self.step[key] = len(ends)
                    ends.append(False)
                    byte_of.append(b)
                    parent.append(at)
                at = self.step[key]
            ends[at] = bool(token)
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a parent has a smaller number
            depth[v] = depth[parent[v]] + 1
        self.fail: list[int] = [-1] * len(ends)  # -1: the text can't be matched on
        self.popped = [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.popped[v] = ROOT, 1
                continue
            z, pops = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and z << 8 | byte_of[v] not in self.step:
                pops += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.step[z << 8 | byte_of[v]], pops

    def count(self, text: bytes) -> int:
        """Pieces of greedy longest matching; -1 if it gets stuck."""
        step, fail, popped = self.step, self.fail, self.popped
        at = n = 0
        for b in text:
            while (to := step.get(at << 8 | b)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = to
        while at:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class WordCounts(dict):
    """Word to its number of pieces, filled on demand."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def read_ranks(vocabulary: str) -> list[bytes]:
    """The byte strings of a rank file; a path, or a name in the folder of public tokenizers."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


_automata: dict[str, LongestMatch] = {}


def automaton(vocabulary: str) -> LongestMatch:
    """This worker's automaton."""
    if vocabulary not in _automata:
        _automata[vocabulary] = LongestMatch(read_ranks(vocabulary))
    return _automata[vocabulary]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: the id, n_words, n_tokens (unknown words included), n_unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordCounts(automaton(vocabulary)).__getitem__
        for batch in slices(batches):
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                counts = list(map(of, words_of(text or "")))
                lost = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
