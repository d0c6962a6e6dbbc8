"""Operator 7: media columns as AVI motion-JPEG.

``to_media`` writes bytes as an AVI file of baseline JPEG frames, ``read_media``
parses an AVI file's RIFF index, decodes its intra frames, finds shots and gives
timed clips and, for files of ours, the stored bytes.

Storage is lossless because bytes become quantised DCT coefficients, the format's
unit: byte b is the 8-bit amplitude field of a coefficient of size class 8, which
has exactly 256 values (b from 128 up, b - 255 below). 64 bytes make a block. The
only Huffman code of either table is eight 0 bits for "no zeros before, size 8",
and a restart follows each block, so every field is a whole byte and DC values
aren't summed up; any JPEG decoder can read the frames.

Shots: the histogram difference of neighbouring frames (16 levels of grey) is a
cut where it exceeds the mean and ``SIGMAS`` standard deviations of the shot's
last ``HISTORY`` differences, and ``FLOOR`` at least (``FIRST`` without history).

Defined results: a null text is an empty one; its payload is one block of zeros.
Equal texts give equal files. Repeated rows are stored each; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices

#: Blocks across and down a frame.
WIDE, HIGH = 8, 2
FPS = 25
SIGMAS, HISTORY, FLOOR, FIRST = 3.0, 12, 0.10, 0.30
#: Bytes of media in an output batch.
BATCH_BYTES = 8_000_000


def _zigzag() -> list[int]:
    """Place in the block, row by row, of the k-th coefficient."""
    cells = [(x, y) for x in range(8) for y in range(8)]
    return [y * 8 + x for x, y in sorted(cells, key=lambda c: (sum(c), c[1] if sum(c) % 2 else c[0]))]


ZIGZAG = np.array(_zigzag())


def _inverse_dct() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to samples row by row."""
    c = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    return np.kron(c, c)[ZIGZAG].astype(np.float32)


INVERSE = _inverse_dct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int) -> bytes:
    """A Huffman table whose only code is eight 0 bits, for symbol 8."""
    return bytes([kind << 4, *(0,) * 7, 1, *(0,) * 8, 8])


def jpeg_head(wide: int = WIDE, high: int = HIGH) -> bytes:
    """What stands before a frame's scan data."""
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0, *(1,) * 64])), _segment(0xC0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, _one_code(0)), _segment(0xC4, _one_code(1)), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode_frames(payload: bytes, wide: int = WIDE, high: int = HIGH) -> list[bytes]:
    """JPEG frames that hold the payload, whose last frame is filled with 0."""
    per = wide * high
    data = np.frombuffer(payload, np.uint8)
    n = max(1, -(-len(data) // (64 * per)))
    data = np.concatenate([data, np.zeros(n * per * 64 - len(data), np.uint8)]).reshape(n, per, 64)
    scan = np.zeros((n, per, 130), np.uint8)
    scan[:, :, 1:128:2] = data
    scan[:, :, 128] = 0xFF
    scan[:, :, 129] = 0xD0 + np.arange(per, dtype=np.uint8) % 8
    head, end = jpeg_head(wide, high), b"\xff\xd9"
    rows = scan.reshape(n, -1)[:, :-2]
    if not (data == 0xFF).any():
        return [head + r.tobytes() + end for r in rows]
    out = []
    stuff = np.zeros((per, 130), bool)
    for r, d in zip(rows, data, strict=True):
        stuff[:, 1:128:2] = d == 0xFF
        out.append(head + np.insert(r, np.flatnonzero(stuff.reshape(-1)) + 1, 0).tobytes() + end)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, note: str = "", fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream, its index, and a comment."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note.encode() + b"\0")) if note else b""
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movie = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + header + info + movie + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> dict:
    """fps, width, height, note and the frames' (offset, length), by the index, or by the chunks where there is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"fps": float(FPS), "width": 0, "height": 0, "note": "", "frames": []}
    movie = (0, 0)
    index = b""
    todo = [(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                if media[body : body + 4] == b"movi":
                    movie = (body, min(body + size, len(media)))
                else:
                    todo.append((body + 4, min(body + size, end)))
            elif name == b"avih":
                step, *_ = struct.unpack_from("<I", media, body)
                out["fps"] = 1e6 / step if step else float(FPS)
                out["width"], out["height"] = struct.unpack_from("<2I", media, body + 32)
            elif name == b"ICMT":
                out["note"] = media[body : body + size].rstrip(b"\0").decode("utf-8", "replace")
            elif name == b"idx1":
                index = media[body : body + size]
            at = body + size + size % 2
    start, stop = movie
    entries = [e for e in struct.iter_unpack("<4s3I", index[: len(index) // 16 * 16]) if e[0][2:] in (b"dc", b"db")]
    if entries:
        base = start if media[start + entries[0][2] : start + entries[0][2] + 4] == entries[0][0] else 0  # offsets count from "movi" or from the file's start
        out["frames"] = [(base + at + 8, size) for _, _, at, size in entries]
    else:
        at = start + 4
        while at + 8 <= stop:
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            if media[at + 2 : at + 4] in (b"dc", b"db"):
                out["frames"].append((at + 8, size))
            at += 8 + size + size % 2
    return out


class Jpeg:
    """The headers of a baseline JPEG frame, and its scan."""

    def __init__(self, frame: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.restart = 0
        at = 2
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
            body = frame[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int32)
                    body = body[1 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker == 0xC4:
                while body:
                    counts, code, k, codes = body[1:17], 0, 17, {}
                    for length, n in enumerate(counts, 1):
                        for _ in range(n):
                            codes[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.tables[body[0] >> 4, body[0] & 15] = codes
                    body = body[k:]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.uses = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("only baseline frames can be decoded")
        self.scan = frame[at:]
        self.whole_bytes = self.restart == 1 and len(self.parts) == 1 and all(t == {(8, 0): 8} for t in self.tables.values())

    def coefficients(self) -> np.ndarray:
        """Blocks of the first part (the luminance) with 64 quantised coefficients each, in zigzag order."""
        if self.whole_bytes:
            raw = np.frombuffer(self.scan, np.uint8)
            raw = raw[: len(raw) - 2]
            mark = np.flatnonzero(raw[:-1] == 0xFF)
            keep = np.ones(len(raw), bool)
            keep[mark + 1] = False
            keep[mark[raw[mark + 1] != 0]] = False
            return amplitudes(raw[keep].reshape(-1, 64, 2)[:, :, 1])
        return self._decoded()

    def _decoded(self) -> np.ndarray:
        across, down = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        units = -(-self.width // (8 * across)) * -(-self.height // (8 * down))
        out: list[list[int]] = []
        before = dict.fromkeys((p[0] for p in self.parts), 0)
        pos = bits = held = 0
        scan = self.scan

        def take(n: int) -> int:
            nonlocal pos, bits, held
            while held < n:
                b = scan[pos] if pos < len(scan) else 0
                if b != 0xFF:
                    pos += 1
                elif scan[pos + 1 : pos + 2] == b"\0":
                    pos += 2
                else:
                    b = 0  # a marker, which isn't passed here
                bits, held = bits << 8 | b, held + 8
            held -= n
            found = bits >> held
            bits &= (1 << held) - 1
            return found

        def symbol(table: dict[tuple[int, int], int]) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (s := table.get((length, code))) is not None:
                    return s
            raise ValueError("broken scan")

        def amplitude(size: int) -> int:
            v = take(size) if size else 0
            return v if not size or v >> size - 1 else v - (1 << size) + 1

        for unit in range(units):
            if self.restart and unit and unit % self.restart == 0:
                bits = held = 0
                while pos + 1 < len(scan) and not (scan[pos] == 0xFF and 0xD0 <= scan[pos + 1] <= 0xD7):
                    pos += 1
                pos += 2
                before = dict.fromkeys(before, 0)
            for k, (name, h, v, _) in enumerate(self.parts):
                dc, ac = (self.tables[c, t] for c, t in enumerate(self.uses[name]))
                for _ in range(h * v if len(self.parts) > 1 else 1):
                    block = [0] * 64
                    before[name] += amplitude(symbol(dc))
                    block[0] = before[name]
                    i = 1
                    while i < 64:
                        s = symbol(ac)
                        if not s & 15:
                            if s >> 4 != 15:
                                break
                            i += 16
                            continue
                        i += s >> 4
                        block[i] = amplitude(s & 15)
                        i += 1
                    if k == 0:
                        out.append(block)
        return np.array(out, np.int32).reshape(-1, 64)


def amplitudes(fields: np.ndarray) -> np.ndarray:
    """Values of 8-bit amplitude fields of size class 8."""
    v = fields.astype(np.int32)
    return np.where(v >= 128, v, v - 255)


def decode_all(media: bytes, frames: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per frame: the coefficients and the quantisation table. Frames of ours, alike in size, are decoded together."""
    head = jpeg_head()
    size = len(head) + WIDE * HIGH * 130
    if frames and all(n == size for _, n in frames) and len({b[0] - a[0] for a, b in zip(frames, frames[1:], strict=False)}) <= 1:
        step = frames[1][0] - frames[0][0] if len(frames) > 1 else size
        raw = np.frombuffer(media, np.uint8)
        rows = np.lib.stride_tricks.as_strided(raw[frames[0][0] :], (len(frames), size), (step, 1), writeable=False)
        if bool((rows[:, : len(head)] == np.frombuffer(head, np.uint8)).all()):
            scan = np.concatenate([rows[:, len(head) : -2], np.tile(np.array([0xFF, 0xD7], np.uint8), (len(frames), 1))], axis=1).reshape(len(frames), -1, 130)
            if not scan[:, :, :128:2].any() and bool((scan[:, :, 128] == 0xFF).all()):
                values = amplitudes(scan[:, :, 1:128:2])
                ones = np.ones(64, np.int32)
                return [(v, ones) for v in values]
    out = []
    for at, n in frames:
        j = Jpeg(media[at : at + n])
        out.append((j.coefficients(), j.quant[j.parts[0][3]]))
    return out


def histograms(decoded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shares of 16 levels of grey, a row per frame."""
    out = []
    for lo in range(0, len(decoded), 256):
        part = decoded[lo : lo + 256]
        samples = np.concatenate([(c * q).astype(np.float32) for c, q in part]) @ INVERSE
        level = np.clip(np.rint(samples + 128), 0, 255).astype(np.int64) >> 4
        frame = np.repeat(np.arange(len(part)), [len(c) for c, _ in part])
        counts = np.bincount((frame[:, None] * 16 + level).ravel(), minlength=16 * len(part)).reshape(-1, 16)
        out.append(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return np.concatenate(out) if out else np.zeros((0, 16))


def shots(levels: np.ndarray) -> list[tuple[int, int]]:
    """Shots as (first frame, frames)."""
    if not len(levels):
        return []
    change = (np.abs(np.diff(levels, axis=0)).sum(1) / 2).tolist()
    starts, past = [0], []
    for t, d in enumerate(change, 1):
        if past:
            mean = sum(past) / len(past)
            limit = max(FLOOR, mean + SIGMAS * math.sqrt(sum((x - mean) ** 2 for x in past) / len(past)))
        else:
            limit = FIRST
        if d > limit:
            starts.append(t)
            past = []
        else:
            past = [*past[-HISTORY + 1 :], d]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(levels)], strict=True)]


def padded(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def media_of(raw: bytes) -> bytes:
    payload = padded(raw)
    return write_avi(encode_frames(payload), WIDE * 8, HIGH * 8, f"payload {len(payload)}")


def payload_of(decoded: list[tuple[np.ndarray, np.ndarray]], note: str) -> bytes | None:
    """The stored bytes of a file of ours, else None."""
    if not note.startswith("payload "):
        return None
    v = np.concatenate([c for c, _ in decoded]).ravel()
    return np.where(v > 0, v, v + 255).astype(np.uint8)[: int(note.split()[1])].tobytes()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_at: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[size_at] or b"") + 100
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (an AVI file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
            rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
            yield from _batches(((i, len(t or b""), media_of(t or b"")) for i, t in rows), schema, 2)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"doc_id {kind}, n_bytes long, media binary")


CLIP = pa.list_(pa.struct([("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per file: the id, payload (null for files of others), n_frames, and clips as an array; ``clips`` makes rows of them. Null and broken
    media (no AVI file, cut-off or damaged frames, kinds of frames other than baseline) have null in all of these."""

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None
        try:
            film = read_avi(raw)
            decoded = decode_all(raw, film["frames"])
        except (ValueError, LookupError, ArithmeticError, struct.error):
            return None, None, None
        found = [{"first_frame": a, "frames": n, "start_s": a / film["fps"], "end_s": (a + n) / film["fps"]} for a, n in shots(histograms(decoded))]
        return payload_of(decoded, film["note"]), len(decoded), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("payload", pa.binary()), ("media", pa.binary()), ("n_frames", pa.int32()), ("clips", CLIP)])
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            made = ((i, m, *one(m)) for i, m in rows)
            yield from _batches(((i, p, m, n, c) for i, m, p, n, c in made), schema, 2)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(freeing(run), f"doc_id {kind}, payload binary, media binary, n_frames int, clips array<struct<first_frame int, frames int, start_s double, end_s double>>")


def clips(read: DataFrame) -> DataFrame:
    """Timed clip rows of what read_media gives."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
