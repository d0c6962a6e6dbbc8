"""Operator 5: language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A
word's probability under a language is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. The
pieces' probabilities are learned by expectation maximisation over the word
counts of a sample of labelled texts: at most ``per_language`` texts of each
language, those with the least hashes of their ids in each of 64 hashed groups.
Prediction uses every word of every text, and nothing but the text.

A word is a run of letters of any length, in lower case, behind a mark for its
beginning. The vocabulary's pieces of such letters are all in use, whatever their
length. All occurrences of pieces in many words are found at once by a trie; the
forward sums of many words go on together, letter by letter. A run that is longer
than a block, such as a text without spaces, is cut into blocks: each block's sums
are a linear map of the sums at the places before it, all blocks' maps are computed
together, and one after the other is applied.

A model has a column of about 0.2 MB for each label there is.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if
there was nothing to learn from; else the language of the highest posterior
(uniform prior; the first in order among equals) with this posterior as score.
Repeated rows are predicted each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import freeing, slices, stored, tokens_of

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
PER_LANGUAGE = 512
GROUPS = 64
ROUNDS = 3
MARK = "▁"
#: Probability of a letter that no piece covers, and what is added to every piece's expected count.
UNKNOWN, SMOOTHING = 1e-7, 0.05
#: Letters of a block; longer runs are cut. Sums over a block stay in range, as every letter's share is multiplied by LETTER.
BLOCK, LETTER = 32, 1e4
#: Bound of each task's memory of words.
REMEMBERED = 150_000
#: New words of texts with about so many characters are learned together.
CHUNK = 1_000_000
#: Numbers of an array of forward sums, and letters of runs that are learned from together.
SUMS, LEARNED_LETTERS = 1_000_000, 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def read_pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters in lower case, with or without the mark; a path, or a name in the folder of public tokenizers."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    return sorted(p for p in found if p == p.lower() and (p == MARK or _LETTERS.fullmatch(p.removeprefix(MARK))))


def runs_of(word: str) -> list[str]:
    """The letter runs of a word as the model sees them."""
    return [MARK + r for r in _LETTERS.findall(word.lower())]


def characters(runs: list[str]) -> np.ndarray:
    """The runs' characters, one after the other."""
    return np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


@dataclass
class Matches:
    """Occurrences of pieces: the run, the places before and behind the piece, and the piece."""

    run: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


class PieceTrie:
    """A trie of the pieces, followed for all places of many runs at once. Characters that many pieces have get a table, others a sorted list of edges."""

    COMMON = 64

    def __init__(self, pieces: list[str]):
        self.unknown, self.longest = len(pieces) + 1, max(map(len, pieces), default=1)
        nodes: dict[tuple[int, str], int] = {}
        piece_at: dict[int, int] = {}
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = nodes.setdefault((node, c), len(nodes) + 1)
            piece_at[node] = number
        used: dict[str, int] = {}
        for _, c in nodes:
            used[c] = used.get(c, 0) + 1
        letters = sorted(used, key=lambda c: (-used[c], c))
        self.letter = np.full(max(map(ord, letters), default=0) + 2, -1)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        code = {c: i for i, c in enumerate(letters)}
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(piece_at)] = list(piece_at.values())
        self.table = np.full((len(nodes) + 1, self.COMMON), -1, np.int32)
        rare: list[tuple[int, int]] = []
        for (node, c), child in nodes.items():
            if code[c] < self.COMMON:
                self.table[node, code[c]] = child
            else:
                rare.append((node << 32 | code[c], child))
        rare.sort()
        self.edges, self.children = np.array([k for k, _ in rare], np.int64), np.array([c for _, c in rare], np.int32)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to; -1 where there is none."""
        common = (letter >= 0) & (letter < self.COMMON)
        out = np.where(common, self.table[node, np.where(common, letter, 0)], np.int32(-1))
        rare = np.flatnonzero(letter >= self.COMMON)
        if len(rare) and len(self.edges):
            keys = node[rare].astype(np.int64) << 32 | letter[rare]
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            out[rare] = np.where(self.edges[at] == keys, self.children[at], -1)
        return out

    def matches(self, runs: list[str]) -> Matches:
        """All pieces at all places, and the unknown piece at letters that are none."""
        sizes = np.array([len(r) for r in runs])
        chars = characters(runs)
        letter = self.letter[np.minimum(chars, len(self.letter) - 1)]
        run = np.repeat(np.arange(len(runs)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[run] - place
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        starts, lengths, found = [], [], []
        for k in range(self.longest):
            inside = left[at] > k
            at, node = at[inside], node[inside]
            node = self.step(node, letter[at + k])
            if k == 0:
                alone = np.flatnonzero((node < 0) | (self.piece[node] < 0))
                starts.append(alone)
                lengths.append(np.ones(len(alone), np.int64))
                found.append(np.full(len(alone), self.unknown, np.int32))
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            whole = self.piece[node] >= 0
            starts.append(at[whole])
            lengths.append(np.full(int(whole.sum()), k + 1))
            found.append(self.piece[node[whole]])
        start, length = np.concatenate(starts or [at]), np.concatenate(lengths or [at])
        return Matches(run[start], place[start], place[start] + length, np.concatenate(found or [at]).astype(np.int64))


def sweep(m: Matches, prob: np.ndarray, segments: int, width: int, lead: int) -> np.ndarray:
    """Forward sums [segment, place, language, basis] of segments of ``width`` places behind ``lead`` places, each of which is 1 in a basis
    of its own; a match's places count from the first of these."""
    alpha = np.zeros((segments, lead + width, prob.shape[1], lead))
    for i in range(lead):
        alpha[:, i, :, i] = 1
    order = np.lexsort((m.run, m.end))
    run, start, end, weight = m.run[order], m.start[order], m.end[order], prob[m.piece[order]][:, :, None]
    first = np.searchsorted(end, np.arange(lead, lead + width + 1))
    for place, (lo, hi) in enumerate(zip(first, first[1:], strict=False), lead):
        if lo < hi:
            heads = np.flatnonzero(np.diff(run[lo:hi], prepend=-1))
            alpha[run[lo:hi][heads], place] = np.add.reduceat(alpha[run[lo:hi], start[lo:hi]] * weight[lo:hi], heads)
    return alpha


def scaled(prob: np.ndarray, pieces: list[str]) -> np.ndarray:
    """The probabilities times LETTER for each letter; the last rows are those of no piece and of an uncovered letter."""
    return prob * np.array([*(LETTER ** len(p) for p in pieces), 1.0, LETTER])[:, None]


def log_probs(runs: list[str], trie: PieceTrie, weights: np.ndarray) -> np.ndarray:
    """[run, language]: the logs of the sums over all segmentations; weights: scaled()."""
    out = np.empty((len(runs), weights.shape[1]))
    short = [i for i, r in enumerate(runs) if len(r) <= BLOCK]
    step = max(1, SUMS // ((BLOCK + 1) * max(1, weights.shape[1])))
    short.sort(key=lambda i: len(runs[i]))  # runs of like lengths go together
    for lo in range(0, len(short), step):
        part = short[lo : lo + step]
        sizes = np.array([len(runs[i]) for i in part])
        alpha = sweep(trie.matches([runs[i] for i in part]), weights, len(part), int(sizes.max()), 1)
        out[part] = np.log(alpha[np.arange(len(part)), sizes, :, 0]) - sizes[:, None] * np.log(LETTER)
    for i in (i for i, r in enumerate(runs) if len(r) > BLOCK):
        out[i] = _long_log_prob(runs[i], trie, weights)
    return out


def _long_log_prob(run: str, trie: PieceTrie, weights: np.ndarray) -> np.ndarray:
    """log_probs of one run in blocks: each is a matrix that maps the sums at the places before it to those at its last places."""
    lead, languages = trie.longest, weights.shape[1]
    block = max(BLOCK, lead)
    sums = np.zeros((languages, lead))
    sums[:, -1] = 1
    logs = np.full(languages, -len(run) * np.log(LETTER))
    batch = block * max(1, SUMS // ((lead + block) * languages * lead))
    for at in range(0, len(run), batch):
        before = max(0, at - lead + 1)
        size = min(len(run), at + batch) - at
        m = trie.matches([run[before : at + size]])
        end = m.end + before - at
        here = end > 0
        segment = (end[here] - 1) // block
        shift = lead - 1 - segment * block
        start, end = m.start[here] + before - at + shift, end[here] + shift
        alpha = sweep(Matches(segment, start, end, m.piece[here]), weights, -(-size // block), block, lead)
        for k in range(alpha.shape[0]):
            places = min(block, size - k * block)
            sums = np.einsum("plb,lb->lp", alpha[k, places : places + lead], sums)
            most = sums.max(1, keepdims=True)
            sums /= most
            logs += np.log(most[:, 0])
    return logs + np.log(sums[:, -1])


def expected_uses(runs: list[str], counts: np.ndarray, trie: PieceTrie, logs: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in runs of any length, by forward and backward sums in logarithms; counts weigh the runs."""
    m, sizes = trie.matches(runs), np.array([len(r) for r in runs])
    weight = logs[m.piece]
    width = int(sizes.max())
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    source, target = offset[m.run] + m.start, offset[m.run] + m.end
    ahead, behind = np.full(int((sizes + 1).sum()), -np.inf), np.full(int((sizes + 1).sum()), -np.inf)
    ahead[offset] = 0.0
    order = np.lexsort((target, m.end))
    first = np.searchsorted(m.end[order], np.arange(1, width + 2))
    for lo, hi in zip(first, first[1:], strict=False):
        if lo < hi:
            o = order[lo:hi]
            heads = np.flatnonzero(np.diff(target[o], prepend=-1))
            ahead[target[o][heads]] = np.logaddexp.reduceat(ahead[source[o]] + weight[o], heads)
    behind[offset + sizes] = 0.0
    left = sizes[m.run] - m.start
    order = np.lexsort((source, left))
    first = np.searchsorted(left[order], np.arange(1, width + 2))
    for lo, hi in zip(first, first[1:], strict=False):
        if lo < hi:
            o = order[lo:hi]
            heads = np.flatnonzero(np.diff(source[o], prepend=-1))
            behind[source[o][heads]] = np.logaddexp.reduceat(behind[target[o]] + weight[o], heads)
    share = np.exp(ahead[source] + weight + behind[target] - ahead[offset + sizes][m.run])
    return np.bincount(m.piece, share * counts[m.run], len(logs))


def learn(counts: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the pieces from counts of runs, then 0 for no piece and UNKNOWN for a letter that no piece covers."""
    trie = PieceTrie(pieces)
    runs = sorted(counts, key=lambda r: (len(r), r))
    parts, lo = [], 0
    while lo < len(runs):
        hi, letters = lo, 0
        while hi < len(runs) and letters < LEARNED_LETTERS:
            letters += len(runs[hi])
            hi += 1
        parts.append((lo, hi))
        lo = hi
    prob = np.full(len(pieces) + 2, 1 / max(1, len(pieces)))
    prob[-2:] = 0, UNKNOWN
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            logs = np.log(prob)
        uses = np.full(len(pieces), SMOOTHING)
        for lo, hi in parts:
            uses += expected_uses(runs[lo:hi], np.array([counts[r] for r in runs[lo:hi]], float), trie, logs)[:-2]
        prob[:-2] = uses / uses.sum()
    return prob


@dataclass
class Model:
    """Languages in order, and a column of probabilities for each: pieces, 'none', uncovered letter."""

    languages: list[str]
    pieces: list[str]
    prob: np.ndarray


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from a bounded sample of the rows with a language and a text."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    h = F.xxhash64(F.lit(5), F.col("doc_id"))
    ids = rows.select("doc_id", "lang", h.alias("h"), F.pmod(h, F.lit(GROUPS)).alias("g"))
    place = F.row_number().over(W.partitionBy("lang", "g").orderBy("h", "doc_id"))
    chosen = stored(ids.withColumn("n", place).filter(F.col("n") <= -(-per_language // GROUPS)).select("doc_id", "lang").distinct(), "sample")
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # at most per_language rows a language

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:  # of a sample
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for word in tokens_of(text):
                    for r in runs_of(word):
                        found[lang, r] = found.get((lang, r), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["lang", "run", "n"])

    counted = sample.select("lang", "text").mapInPandas(freeing(count), "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        prob = learn(dict(zip(pdf["run"], pdf["n"], strict=True)), read_pieces(vocabulary))
        return pd.DataFrame({"lang": [pdf["lang"].iat[0]], "prob": [prob.tolist()]})

    fitted = {r["lang"]: r["prob"] for r in counted.groupBy("lang").applyInPandas(fit, "lang string, prob array<double>").collect()}  # a vector of the vocabulary's size per language
    names = sorted(fitted)
    pieces = read_pieces(vocabulary)
    return Model(names, pieces, np.array([fitted[x] for x in names]).T if names else np.zeros((len(pieces) + 2, 0)))


class Scorer(dict):
    """Word to its row in ``rows``: the log probabilities under each language, and its number of letters."""

    def __init__(self, model: Model):
        self.model = model
        self.trie, self.weights = PieceTrie(model.pieces), scaled(model.prob, model.pieces)
        self.rows = np.zeros((1024, len(model.languages) + 1))

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows[: len(self)], np.zeros((len(self) // 2 + len(words), self.rows.shape[1]))])
        numbers: dict[str, int] = {}
        owners: list[int] = []
        uses: list[int] = []
        first = len(self)
        for i, w in enumerate(words, first):
            self[w] = i
            for r in runs_of(w):
                owners.append(i)
                uses.append(numbers.setdefault(r, len(numbers)))
        self.rows[first : len(self)] = 0
        if numbers and self.model.languages:
            runs = list(numbers)
            found = np.column_stack([log_probs(runs, self.trie, self.weights), [len(r) - 1 for r in runs]])
            np.add.at(self.rows, owners, found[uses])

    def forget(self) -> None:
        """Keeps the younger half of the words."""
        young = list(self)[len(self) // 2 :]
        self.rows = self.rows[len(self) - len(young) : len(self)].copy()
        self.clear()
        self.update(zip(young, range(len(young)), strict=True))

    def scores(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        """Language and posterior of each text; new words are learned for many texts at once."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and chars < CHUNK:
                chars += len(texts[hi])
                hi += 1
            cut = [tokens_of(t) for t in texts[lo:hi]]
            new = set().union(*cut).difference(self)
            if new:
                self.learn(new)
            for words in cut:
                yield self.decide(self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0))
            if len(self) > REMEMBERED:
                self.forget()
            lo = hi

    def decide(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1] or not self.model.languages:
            return UNDETERMINED, 0.0
        logs = total[:-1]
        best = int(np.argmax(logs))
        return self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = list(scorer.scores([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"doc_id {kind}, lang_pred string, score double")


def kept_rows(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The whole rows whose language can be told with a score of at least ``least``; each row goes to Python once, with its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the languages
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = scorer.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(freeing(run), docs.schema)
