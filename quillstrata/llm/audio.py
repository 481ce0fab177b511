"""Telephony audio columns: mu-law, A-law and IMA ADPCM sound, stored as resampled PCM.

Samples expand by lookup tables; ADPCM blocks decode one nibble position at a
time across all blocks of a batch. What is stored is 16-bit PCM at twice the rate.
A-law bytes and their PCM values correspond one to one, so the telephony payload is
read back from every second stored sample.

Defined results: a null or empty text is one frame of padding; equal texts give
equal values, whatever rows surround them, since all features are sums of
integers; a payload that is no multiple of an ADPCM block is padded with bytes 255
for that decoder; media that are null, no WAV file, without samples, of another format, or
PCM that does not come from A-law have null payloads and features, with their size and digest; repeated
rows and repeated or null ids are kept; ids of a type other than integers raise
``TypeError``; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.arrowtext import doc_blocks, integer_id, map_batches, utf8
from quillstrata.sources import durable_table

#: Bytes of padding value and of a frame; two ADPCM blocks are one frame.
PAD, FRAME, ADPCM_BLOCK = 255, 576, 288
RATE = 8000
TAIL = 32
#: Payload bytes decoded at once.
BATCH = 2 << 20
# Format tags of WAV files.
PCM, ALAW, MULAW = 1, 6, 7
# Step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@functools.cache
def mulaw_table() -> np.ndarray:
    """16-bit value of every mu-law byte: complemented sign, exponent, mantissa."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """16-bit value of every A-law byte: even bits inverted, segment, mantissa."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = (a >> 4) & 7, ((a & 0x0F) << 4) + 8
    size = np.where(segment == 0, size, (size + 0x100) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decode IMA ADPCM blocks (rows of bytes) to one row of samples each.

    A block starts with its first sample, its step index (larger ones count as
    the largest) and a spare byte; low nibbles come first.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    coded = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(coded), len(blocks)), np.int16)
    out[0] = value
    for k, row in enumerate(coded):
        for half, nibble in enumerate((row & 15, row >> 4)):
            step, size = STEPS[index], (nibble & 7).astype(np.int32)
            move = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * ((size >> 1) & 1) + step * (size >> 2)
            value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
            index = np.clip(index + MOVES[size], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = value
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Double the rate: means between neighbours; the last sample repeats."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def wav(samples: bytes, tag: int, rate: int, width: int = 1) -> bytes:
    """Return a one-channel WAV file."""
    pad = b"\0" * (len(samples) % 2)
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * width, width, 8 * width, 0)
    fact = struct.pack("<I", len(samples) // width)
    size = 4 + 8 + len(fmt) + 8 + len(fact) + 8 + len(samples) + len(pad)
    return b"".join((b"RIFF", struct.pack("<I", size), b"WAVEfmt ", struct.pack("<I", len(fmt)), fmt, b"fact", struct.pack("<I", 4), fact, b"data", struct.pack("<I", len(samples)), samples, pad))


def read_wav(stored: bytes | None) -> tuple[int, int, bytes] | None:
    """Return (format tag, rate, samples) of a WAV file by walking its chunks, or None if it is none."""
    if stored is None or stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        return None
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 16 <= len(stored):
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            samples = stored[at + 8 : at + 8 + size]
            return (tag, rate, samples) if len(samples) == size and size and rate else None
        at += 8 + size + size % 2
    return None


def store_texts(df: DataFrame, tag: int = ALAW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, n_bytes, media): each text's bytes as 8-bit samples of a WAV file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in doc_blocks(offsets, BATCH):
                raw = data[offsets[i] : offsets[j]].tobytes()
                at = (offsets[i : j + 1] - offsets[i]).tolist()
                files = []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    fill = FRAME if a == b else -(b - a) % FRAME
                    files.append(wav(raw[a:b] + bytes([PAD]) * fill, tag, RATE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1]), pa.int64()), pa.array(files, pa.binary())], schema=schema)

    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, media binary")


def _sums(pcm: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Peak, sum of squares and sign changes of each segment."""
    wide = pcm.astype(np.int32)
    size = np.abs(wide)
    flips = np.zeros(len(pcm), np.int64)
    flips[1:] = (wide[1:] ^ wide[:-1]) < 0
    flips[starts] = 0
    return [np.maximum.reduceat(size, starts), np.add.reduceat(wide.astype(np.int64) ** 2, starts), np.add.reduceat(flips, starts)]


def _expand(tag: int, samples: bytes) -> np.ndarray | None:
    """PCM of telephony samples; None if the format is not mu-law or A-law."""
    table = {ALAW: alaw_table, MULAW: mulaw_table}.get(tag)
    return table and table()[np.frombuffer(samples, np.uint8)]


def to_pcm(media: DataFrame) -> DataFrame:
    """Turn (doc_id, n_bytes, media) of telephony files into 16-bit WAV files at twice the rate; others become null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for stored in batch.column(2):
                tag, rate, samples = read_wav(stored.as_py()) or (0, 0, b"")
                pcm = _expand(tag, samples)
                files.append(None if pcm is None else wav(resample_double(pcm).tobytes(), PCM, 2 * rate, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(files, pa.binary())], schema=schema)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, media binary")


@functools.cache
def _alaw_back() -> np.ndarray:
    """A-law byte of every 16-bit value (by its unsigned bits), or -1."""
    back = np.full(1 << 16, -1, np.int16)
    back[alaw_table().view(np.uint16)] = np.arange(256)
    return back


def payload_of(stored: bytes | None) -> tuple[bytes, bytes] | None:
    """Return (telephony payload, PCM samples at twice the rate) of a stored file, or None."""
    tag, _, samples = read_wav(stored) or (0, 0, b"")
    pcm = _expand(tag, samples)
    if pcm is not None:
        return samples, resample_double(pcm).tobytes()
    if tag != PCM or len(samples) % 4:
        return None
    wide = np.frombuffer(samples, "<i2")
    back = _alaw_back()[wide[::2].view(np.uint16)]
    return (back.astype(np.uint8).tobytes(), samples) if (back >= 0).all() and np.array_equal(resample_double(wide[::2]), wide) else None


def _describe(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Features of telephony payloads and of the PCM stored beside them."""
    lengths = np.array([len(x) for x in payloads])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(payloads), np.uint8)
    blocks = -(-lengths // ADPCM_BLOCK)
    whole = np.frombuffer(b"".join(x + bytes([PAD]) * (-len(x) % ADPCM_BLOCK) for x in payloads), np.uint8)
    adpcm = decode_adpcm(whole.reshape(-1, ADPCM_BLOCK))
    first = (np.cumsum(blocks) - blocks) * adpcm.shape[1]
    sounds = [("mulaw", mulaw_table()[data], starts, lengths), ("alaw", alaw_table()[data], starts, lengths), ("adpcm", adpcm.ravel(), first, blocks * adpcm.shape[1])]
    texts = []
    for name, sound, at, n in sounds:
        peak, square, flips = _sums(sound, at)
        root = np.sqrt(square // n).astype(np.int64)
        texts.append([f"{name}={p}:{r}:{f}" for p, r, f in zip(peak.tolist(), root.tolist(), flips.tolist(), strict=True)])
    wide = [zlib.crc32(x) for x in pcm]
    return [";".join((*x, f"pcm16k={w:08x}")) for *x, w in zip(*texts, wide, strict=True)]


def media_features(media: DataFrame) -> DataFrame:
    """Read stored files (doc_id, n_bytes, media) back and describe them.

    Per file: digests of the telephony payload and of the file, and for the payload as
    mu-law, A-law and ADPCM the peak, root mean square and sign changes, and the checksum
    of the PCM at twice the rate.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.append(0, np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2)]))
            for i, j in doc_blocks(sizes, BATCH):
                part = batch.slice(i, j - i)
                stored = part.column(2).to_pylist()
                read = [payload_of(x) for x in stored]
                good = [k for k, x in enumerate(read) if x]
                payload = [x[0] if x else None for x in read]
                feature: list[str | None] = [None] * len(stored)
                for k, text in zip(good, _describe(*zip(*(read[k] for k in good), strict=True)) if good else (), strict=True):
                    feature[k] = text
                rows = [
                    part.column(0),
                    part.column(1),
                    [None if x is None else len(x) for x in payload],
                    [None if x is None else hashlib.sha256(x).hexdigest() for x in payload],
                    [None if x is None else zlib.crc32(x[-TAIL:]) for x in payload],
                    [None if x is None else len(x) for x in stored],
                    [None if x is None else hashlib.sha256(x).hexdigest() for x in stored],
                    feature,
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, schema.types, strict=True)], schema=schema)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def store(df: DataFrame, tag: int = ALAW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text's telephony sound as resampled PCM to the shared folder; return the table's reader."""
    return durable_table(to_pcm(store_texts(df, tag, id_col, text_col)), level=6)
