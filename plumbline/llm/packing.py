"""Operator 1: best-fit packing of token sequences.

Every document becomes its token ids and an end id. Documents longer than a
sequence are cut into whole pieces. Pieces are dealt evenly into groups of about
``group``; each group is packed online, in the order in which its pieces come, by
bounded-space best fit: at most ``open_bins`` bins are open, a bitset keyed by free
space finds the tightest bin in a few machine-word operations, and when a new bin
is needed beyond the bound, the fullest open bin closes. The bound binds: of 20,229
pieces of the test tables, in 9,633 sequences (9,559 would be full ones), 4,822 bins
were closed by it; a bound of 1,024 gives as many sequences, one of 24 0.15 % more.

Equal lengths are packed in the order in which they come, too. Texts are taken in
slices of bounded bytes, and what is remembered of words is bounded and freed when a
task ends, so a very long text takes a few times its own size. The tokenizer's tables
don't grow with the texts; a worker keeps them for its next task.

Defined results: a null or blank text is one piece holding only the end id.
Repeated rows and repeated ids are packed each on its own. An empty table gives
an empty table. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices, stored, tokens_of

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 0
#: Pieces packed by one task; group count follows the data.
GROUP = 65_536
OPEN_BINS = 64
#: Words that a task remembers with their ids (about 200 bytes each), and characters of texts whose words are learned together.
REMEMBERED, CHUNK = 400_000, 1_000_000

# Fixed values of the vocabulary's own splitting rule, for words of these letters only.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = re.compile("[A-Za-zß-öø-ÿ]+")


def _byte_names() -> dict[str, int]:
    """The vocabulary's names of bytes: printable characters of Latin-1 for themselves, the others from U+0100 on."""
    marks = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in marks} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in marks)}


class RankedPieces:
    """Ids of a plain word's pieces by merging byte ranks. The merges end words, so a byte at a piece's end is another symbol than the
    same byte before: bytes that plain pieces can hold are renamed to 246 symbols, and a token's rank is its id, as ids follow the merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        tails = range(0x80, 0xC0)
        ascii_bytes = [b for b in range(33, 127) if not chr(b).isdigit() and not chr(b).isupper()]
        inner, last = [*ascii_bytes, 0xC2, 0xC3, *tails], [*ascii_bytes, *tails]
        code = {(b, end): k for k, (b, end) in enumerate([*((b, False) for b in inner), *((b, True) for b in last)])}
        names, ranks = _byte_names(), {}
        for token, i in vocabulary.items():
            shown = token.removesuffix("</w>")
            symbols = [(names.get(c, -1), shown is not token and k == len(shown) - 1) for k, c in enumerate(shown)]
            if all(s in code for s in symbols):
                ranks[bytes(code[s] for s in symbols)] = i
        for b in range(256):
            ranks.setdefault(bytes([b]), len(vocabulary) + 512 + b)  # symbols of no piece
        self._merge = tiktoken.Encoding("plain", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._inner = bytes(code.get((b, False), 255) for b in range(256))
        self._last = [bytes([code.get((b, True), 255)]) for b in range(256)]
        self._digits = {str(d): array("I", [vocabulary[f"{d}</w>"]]).tobytes() for d in range(10)}

    def ids(self, piece: str) -> bytes:
        if piece in self._digits:
            return self._digits[piece]
        raw = piece.encode()
        return array("I", self._merge(raw[:-1].translate(self._inner) + self._last[raw[-1]])).tobytes()


@lru_cache(maxsize=1)
def tables(path: str) -> tuple:
    """The tokenizer of a vocabulary and its RankedPieces, which a worker loads once: for a task of some 10 MB of texts, this is a tenth of its time."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), RankedPieces(path)


class TokenBytes:
    """Texts to their ids as little-endian unsigned 32-bit bytes. A word's ids don't depend on the words around it, so words are remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path = path
        self.whole, self.ranked = tables(path)
        self.words: dict[str, bytes] = {}
        self.remembered = remembered

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text; the new words of texts with about CHUNK characters are learned together."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and chars < CHUNK:
                chars += len(texts[hi])
                hi += 1
            cut = [tokens_of(t) for t in texts[lo:hi]]
            self._learn(set().union(*cut).difference(self.words))
            for words in cut:
                yield b"".join(map(self.words.__getitem__, words))
            if len(self.words) > self.remembered:  # the older half is forgotten and encoded anew when it comes back
                self.words = dict(list(self.words.items())[len(self.words) // 2 :])
            lo = hi

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def _learn(self, new: set[str]) -> None:
        ids, rest = self.ranked.ids, []
        for w in new:
            if _LETTERS.fullmatch(w):
                self.words[w] = ids(w.lower())
            elif "<|" not in w and _PLAIN.fullmatch(w):
                self.words[w] = b"".join(map(ids, _PIECE.findall(w.lower())))
            else:
                rest.append(w)
        for lo in range(0, len(rest), 1024):
            for w, e in zip(rest[lo : lo + 1024], self.whole.encode_batch_fast(rest[lo : lo + 1024], add_special_tokens=False), strict=True):
                self.words[w] = array("I", e.ids).tobytes()


def encoder(vocabulary: str) -> TokenBytes:
    """An encoder; vocabulary is a path or a name in the folder of public tokenizers."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenBytes(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode_all, array("I", [end_id]).tobytes()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, coded in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = coded + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """For each length, in the order given: its bin and its offset there. No length exceeds size."""
    free = 0  # bit f: an open bin has f places free
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    opened = made = 0
    out = []
    for length in lengths:
        fits = free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                free ^= 1 << room
            opened -= 1
        else:
            at, room, made = made, size, made + 1
            if opened == open_bins:
                full = (free & -free).bit_length() - 1  # the fullest closes first
                stacks[full].pop()
                if not stacks[full]:
                    free ^= 1 << full
                opened -= 1
        out.append((at, size - room))
        left = room - length
        if left:
            stacks[left].append(at)
            free |= 1 << left
            opened += 1
    return out


def pack(parts: DataFrame, size: int = SEQUENCE, group: int = GROUP, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to size. ``parts`` must be stored: its rows come in the order of their places there."""
    n_groups = max(1, -(-parts.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        places = best_fit(pdf["length"].tolist(), size, open_bins)
        base = int(pdf["_group"].iat[0]) << 32 if len(pdf) else 0
        return pdf.assign(sequence_id=[base + b for b, _ in places], offset=[o for _, o in places]).drop(columns=["_group", "_at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    dealt = parts.withColumn("_at", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(n_groups)))
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SEQUENCE, group: int = GROUP, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenizes, cuts and packs; one row per piece."""
    return pack(stored(pieces(docs, id_col, text_col, vocabulary, size), "pieces"), size, group, open_bins)
