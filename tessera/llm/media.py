"""Media columns: AVI files of motion JPEG frames, written, parsed, decoded and cut into shots.

Writing. A payload is the bytes of a text, padded with 255 to a positive multiple of 576. Each 576 bytes are one
24 x 24 baseline JPEG frame of nine blocks. A byte is stored as one quantised DCT coefficient: coefficients of
magnitude category 8 (-255..-128 and 128..255) are exactly 256, and the eight bits that code one are the byte, so the
entropy-coded data has 9 bits a byte (a one-bit Huffman code, then the byte), is lossless and needs no search for code
ends. Three blocks at a time are followed by a restart marker, which keeps DC predictions in range.

Reading. RIFF chunks and the ``idx1`` index are parsed, frames are cut by their index entries, JPEG headers are read by
markers, and entropy-coded data is decoded for many frames of a file at once; frames coded otherwise go through a
bitwise decoder of baseline Huffman data. Both give the quantised coefficients, whose bytes are the payload, and then
the picture: DC predictions are summed, coefficients dequantised and transformed back to 8-bit samples.

Shots. Frames have a 16-bin histogram of their samples; a cut lies where the difference to the frame before exceeds both
a floor and the mean plus three standard deviations of the differences in the ``SPAN`` frames before. Clips are timed
at ``RATE`` frames a second.

Null and empty texts give one frame of padding. Every row is coded on its own, so equal texts have equal values, ties and
repeats included; columns besides doc_id and text are left out, so their names cannot clash. Files are written and read
``CHUNK`` frames at a time, so a very long text needs a few times its own size (up to 1.7 GB, where RIFF and Arrow end).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches

UNIT, SIDE, RATE = 576, 24, 25
BINS, SPAN, FLOOR = 16, 8, 0.12
#: Frames that are coded or decoded at once.
CHUNK = 2048


def _basis() -> np.ndarray:
    """The samples of a block for each coefficient in zigzag order, one row each."""
    at = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    wave = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.stack([np.outer(wave[u], wave[v]).ravel() for u, v in at])


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One Huffman code, "0", for category 8 (DC) and for run 0, category 8 (AC); quantisation by 1; a restart each 3 blocks.
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + b"\x01" + bytes(15) + b"\x08")
    + _segment(0xC4, b"\x10" + b"\x01" + bytes(15) + b"\x08")
    + _segment(0xDD, struct.pack(">H", 3))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def payload_of(text: str | None) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _frames(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of frames one after the other, and the size of each JPEG file."""
    frames = len(units) // UNIT
    bits = np.zeros((len(units), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(units[:, None], axis=1)
    coded = np.packbits(bits.reshape(frames, -1), axis=1)  # 648 bytes a frame
    head = np.frombuffer(b"00dc\x00\x00\x00\x00" + _HEAD, np.uint8)
    wide = np.empty((frames, len(head) + 648 + 6 + 1), np.uint8)
    wide[:, : len(head)], wide[:, -1] = head, 0
    at, third = len(head), 216
    stuffed = np.zeros(wide.shape, bool)
    for k, end in enumerate((b"\xff\xd0", b"\xff\xd1", b"\xff\xd9")):
        wide[:, at : at + third] = coded[:, k * third : (k + 1) * third]
        stuffed[:, at : at + third] = wide[:, at : at + third] == 255
        wide[:, at + third : at + third + 2] = np.frombuffer(end, np.uint8)
        at += third + 2
    sizes = (wide.shape[1] - 9 + stuffed.sum(1)).astype("<u4")
    wide[:, 4:8] = sizes.view(np.uint8).reshape(-1, 4)
    copies = 1 + stuffed.astype(np.int64)
    copies[:, -1] = sizes % 2  # chunks begin at even places
    copies = copies.ravel()
    out = np.repeat(wide.ravel(), copies)
    out[np.cumsum(copies)[stuffed.ravel()] - 1] = 0
    return out, sizes


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds a payload of whole frames."""
    units = np.frombuffer(payload, np.uint8)
    parts = [_frames(units[lo : lo + CHUNK * UNIT]) for lo in range(0, len(units), CHUNK * UNIT)]
    sizes = np.concatenate([n for _, n in parts])
    frames = len(sizes)
    index = np.zeros(frames, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, sizes
    whole = 8 + sizes.astype(np.int64) + sizes % 2
    index["at"] = 4 + np.cumsum(whole) - whole
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)
    most = int(sizes.max())
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, frames, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, frames, most, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi = [b"LIST" + struct.pack("<I", 4 + int(whole.sum())) + b"movi", *(part.tobytes() for part, _ in parts)]
    body = [b"AVI " + hdrl, *movi, chunk(b"idx1", index.tobytes())]
    return b"".join([b"RIFF" + struct.pack("<I", sum(map(len, body))), *body])


def read_index(avi: bytes) -> np.ndarray:
    """Start and size of every video frame, by the file's index."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(avi, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, at + 8)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    index = index[index["id"] == b"00dc"]
    return np.stack([movi + index["at"].astype(np.int64) + 8, index["size"].astype(np.int64)], 1)


class Header:
    """What a frame's markers say: Huffman tables by class and number, quantisation by zigzag place, blocks across and
    down, blocks of a restart interval (0: none), and where entropy-coded data starts."""

    def __init__(self, frame: bytes):
        at, self.tables, self.quantum, self.across, self.down, self.restart = 2, {}, np.ones(64), 0, 0, 0
        while True:
            marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + size]
            if marker == 0xDB:
                if body[0] >> 4:
                    raise ValueError("8-bit quantisation only")
                self.quantum = np.frombuffer(body[1:65], np.uint8).astype(np.float64)
            elif marker == 0xC0:
                height, width, parts = struct.unpack_from(">HHB", body, 1)
                if parts != 1:
                    raise ValueError("one component only")
                self.across, self.down = -(-width // 8), -(-height // 8)
            elif marker == 0xC4:
                while body:
                    code, k, codes = 0, 17, {}
                    for length in range(1, 17):
                        for _ in range(body[length]):
                            codes[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.tables[body[0] >> 4, body[0] & 15] = codes
                    body = body[k:]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            at += 2 + size
            if marker == 0xDA:
                self.size = at
                return

    @property
    def blocks(self) -> int:
        return self.across * self.down


def _bitwise(parts: list[bytes], head: Header) -> np.ndarray:
    """The coefficients of one frame, a row a block in zigzag order with the DC as its difference, from any baseline
    coding of them. parts: restart intervals without stuffing."""
    out: list[list[int]] = []
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).tolist()
        at = 0

        def symbol(codes: dict, bits=bits) -> int:
            nonlocal at
            code = length = 0
            while (length, code) not in codes:
                code, at, length = code << 1 | bits[at], at + 1, length + 1
                if length > 16:
                    raise ValueError("bad Huffman code")
            return codes[length, code]

        def number(size: int, bits=bits) -> int:
            nonlocal at
            value = int("".join(map(str, bits[at : at + size])) or "0", 2)
            at += size
            return value if not size or value >> size - 1 else value - (1 << size) + 1

        for _ in range(min(head.restart or head.blocks, head.blocks - len(out))):
            block = [number(symbol(head.tables[0, 0]))]
            while len(block) < 64:
                run_size = symbol(head.tables[1, 0])
                if not run_size:
                    block += [0] * (64 - len(block))
                else:
                    block += [0] * (run_size >> 4) + [number(run_size & 15)]
            out.append(block)
    return np.array(out, np.int32)


_OWN = {(0, 0): {(1, 0): 8}, (1, 0): {(1, 0): 8}}


def _coefficients(avi: bytes, frames: np.ndarray) -> tuple[np.ndarray, Header]:
    """The coefficients of some frames of one size: frame, block, place."""
    head = Header(avi[frames[0, 0] : frames[0].sum()])
    data, first = np.frombuffer(avi, np.uint8), avi[frames[0, 0] : frames[0, 0] + head.size]
    heads = data[frames[:, :1] + np.arange(head.size)]
    if head.blocks == UNIT // 64 and head.tables == _OWN and (heads == np.frombuffer(first, np.uint8)).all():
        length = frames[:, 1] - head.size
        at = np.arange(length.sum()) + np.repeat(frames[:, 0] + head.size - np.cumsum(length) + length, length)
        coded = data[at]
        after = np.zeros(len(coded), bool)  # stuffing, or the second byte of a marker
        after[1:] = coded[:-1] == 255
        marker = after & (coded >= 0xD0)
        drop = after
        drop[:-1] |= marker[1:]
        coded = coded[~drop]
        if len(coded) == 648 * len(frames):
            bits = np.unpackbits(coded).reshape(-1, 9)
            if not bits[:, 0].any():
                units = np.packbits(bits[:, 1:], axis=1).reshape(len(frames), -1, 64).astype(np.int32)
                return np.where(units >= 128, units, units - 255), head
    rows = []
    for begin, size in frames.tolist():
        frame = avi[begin : begin + size]
        own = Header(frame)
        parts, part, k = [], bytearray(), own.size
        while k < len(frame) - 1:
            if frame[k] == 255:
                if frame[k + 1]:
                    parts.append(bytes(part))
                    part = bytearray()
                else:
                    part.append(255)
                k += 2
            else:
                part.append(frame[k])
                k += 1
        rows.append(_bitwise(parts, own))
    return np.stack(rows), head


def pictures(coefficients: np.ndarray, head: Header) -> np.ndarray:
    """The frames' samples: DC differences summed over restart intervals, dequantised, transformed back."""
    values, step = coefficients.astype(np.float64), head.restart or head.blocks
    for lo in range(0, head.blocks, step):
        values[:, lo : lo + step, 0] = np.cumsum(values[:, lo : lo + step, 0], axis=1)
    samples = (values * head.quantum).reshape(-1, 64) @ BASIS
    samples = np.clip(np.rint(samples) + 128, 0, 255).astype(np.uint8)
    return samples.reshape(len(values), head.down, head.across, 8, 8).swapaxes(2, 3).reshape(len(values), head.down * 8, head.across * 8)


def decode(avi: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units (a row a frame) and samples (frame, line, column) of ``CHUNK`` frames at a time."""
    frames = read_index(avi)
    for lo in range(0, len(frames), CHUNK):
        found, head = _coefficients(avi, frames[lo : lo + CHUNK])
        yield (found + 255 * (found < 0)).astype(np.uint8).reshape(len(found), -1), pictures(found, head)


def decode_frames(avi: bytes) -> np.ndarray:
    """The units of all frames, one row of 576 each."""
    return np.concatenate([units for units, _ in decode(avi)])


def histograms(samples: np.ndarray) -> np.ndarray:
    """Counts of samples in BINS equal bins, a row a frame."""
    frames = len(samples)
    cells = np.arange(frames)[:, None] * BINS + (samples.reshape(frames, -1) >> 4)
    return np.bincount(cells.ravel(), minlength=frames * BINS).reshape(frames, BINS)


def shots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and the difference of each frame's histogram to the one before (0 to 1)."""
    frames = len(counts)
    change = np.zeros(frames)
    change[1:] = np.abs(np.diff(counts, axis=0)).sum(1) / (2 * counts[:1].sum())
    total, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    at = np.arange(frames)
    low = np.maximum(1, at - SPAN)
    n = np.maximum(1, at - low)
    mean = (total[at] - total[np.minimum(low, at)]) / n
    spread = np.sqrt(np.maximum(0, (squares[at] - squares[np.minimum(low, at)]) / n - mean**2))
    cut = (change > FLOOR) & (change > mean + 3 * spread + 1e-9)
    cut[:1] = True
    return np.flatnonzero(cut), change


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI file of each text."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                texts = part["text"].to_pylist()
                sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                yield pa.record_batch([part["doc_id"], pa.array(sizes, pa.int64()), pa.array([write_avi(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_batches(docs.select("doc_id", "text"), written, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _clips(first: np.ndarray, frames: int) -> list[tuple[int, int, int, int]]:
    """Start and end in milliseconds, first frame and number of frames of each shot."""
    ends = [*first[1:].tolist(), frames]
    return [(a * 1000 // RATE, b * 1000 // RATE, a, b - a) for a, b in zip(first.tolist(), ends, strict=True)]


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip (from 0), start_ms, end_ms, first_frame, n_frames, brightness of the shots of each file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, avi in zip(batch["doc_id"], batch["media"], strict=True):
                seen = [(histograms(s), s.reshape(len(s), -1).mean(1)) for _, s in decode(avi.as_py())]
                counts, bright = (np.concatenate(x) for x in zip(*seen, strict=True))
                found = _clips(shots(counts)[0], len(counts))
                columns = [range(len(found)), *zip(*found, strict=True), [float(bright[a : a + n].mean()) for *_, a, n in found]]
                yield pa.record_batch([pa.array([doc.as_py()] * len(found), batch["doc_id"].type), *(pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(columns))], ["doc_id", "clip", "start_ms", "end_ms", "first_frame", "n_frames", "brightness"])

    return in_batches(media.select("doc_id", "media"), cut, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, clip long, start_ms long, end_ms long, first_frame long, n_frames long, brightness double")


def _read(avi: bytes) -> tuple:
    """What digest() tells of one file."""
    sha, tail, size, light, seen = hashlib.sha256(), b"", 0, 0, []
    for units, samples in decode(avi):
        payload = units.tobytes()
        sha.update(payload)
        tail, size, light = (tail + payload)[-32:], size + len(payload), light + int(samples.sum(dtype=np.int64))
        seen.append(histograms(samples))
    first, change = shots(np.concatenate(seen))
    found = _clips(first, len(change))
    feature = f"frames={len(change)};shots={len(found)};longest={max(n for *_, n in found)};peak={change.max():.4f};brightness={light / size:.3f}"
    return size, sha.hexdigest(), zlib.crc32(tail), len(avi), hashlib.sha256(avi).hexdigest(), feature, ",".join(f"{a}-{b}" for a, b, *_ in found)


def digest(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: sizes, digests of payload and file, a summary of the pictures, and the
    clips' times in milliseconds."""
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "clips": "string"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(avi.as_py()) for avi in batch["media"]]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([batch["doc_id"], batch["n_bytes"], *(pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(columns, kinds.values(), strict=True))], ["doc_id", "n_bytes", *kinds])

    return in_batches(media.select("doc_id", "n_bytes", "media"), read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))


def op10_motion_jpeg(spark, sf_dir: str) -> DataFrame:
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
