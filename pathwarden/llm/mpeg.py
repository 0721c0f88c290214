"""MPEG audio columns: writing, resynchronising, checking and indexing frames.

The writer stores bytes losslessly as ancillary data of MPEG-1 layer III frames
(mono, 48 kHz, with checksum).  A frame has 576 bytes of data behind
a side information of zeros, which says that no audio bits follow; decoders play
silence of exact length.  The stream has an ID3v2 tag, a Xing frame with the
counts of frames and bytes and a seek table, the data frames and an ID3v1 tag.
Data frames that end on padding use the next higher bit rate, so rates vary.

The reader takes any byte string: it skips and parses tags, looks for a header
whose checksum holds or whose successor fits (or that ends the stream), verifies checksums, reads the Xing
table, and gives the duration in samples and the offset of every frame.  Bytes
between frames are skipped and counted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
SAMPLES = 1152
# Fixed values of the format: kbit/s by index for MPEG-1 layer III, and Hz by index.
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES = [44100, 48000, 32000]
SIDE_MONO, SIDE_STEREO = 17, 32
_SUB = 1  # index of 48 kHz
_FULL, _LAST = 12, 13  # bit-rate indexes of data frames: 224 and 256 kbit/s


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_crc_seen: dict[bytes, int] = {}


def _crc(data: bytes) -> int:
    """As :func:`crc16`, remembering up to 4096 results; most heads are alike."""
    if data not in _crc_seen:
        if len(_crc_seen) >= 4096:
            _crc_seen.clear()
        _crc_seen[data] = crc16(data)
    return _crc_seen[data]


def _header(bitrate: int) -> bytes:
    return bytes([0xFF, 0xFA, bitrate << 4 | _SUB << 2, 0xC0])


def frame_length(head: bytes) -> int:
    """Bytes of the frame that starts with this header, 0 if it is none of MPEG-1 layer III."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xFE != 0xFA:
        return 0
    bit, sub = head[2] >> 4, head[2] >> 2 & 3
    if bit in (0, 15) or sub == 3:
        return 0
    return 144_000 * BITRATES[bit] // RATES[sub] + (head[2] >> 1 & 1)


def _stem(bitrate: int) -> bytes:
    h = _header(bitrate)
    side = bytes(SIDE_MONO)
    return h + _crc(h[2:4] + side).to_bytes(2, "big") + side


_STEM = len(_stem(_FULL))


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def encode(payload: bytes) -> bytes:
    """The stream that stores ``payload``, whose length must be a multiple of 576."""
    n = len(payload) // UNIT
    if len(payload) % UNIT or not n:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    last = payload[-1] == 0xFF
    size, size_last = frame_length(_header(_FULL)), frame_length(_header(_LAST if last else _FULL))
    body = np.zeros((n, size), np.uint8)
    body[:, :_STEM] = np.frombuffer(_stem(_FULL), np.uint8)
    body[:, _STEM : _STEM + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    frames = body.tobytes()
    if last:
        frames = frames[: (n - 1) * size] + (_stem(_LAST) + payload[-UNIT:]).ljust(size_last, b"\0")
    xing_size = size
    total = xing_size + len(frames)
    # Byte 256ths of the stream at each hundredth of its duration.
    toc = bytes(min(255, (xing_size + (i * n // 100) * size) * 256 // total) for i in range(100))
    xing = (_stem(_FULL) + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc).ljust(xing_size, b"\0")
    text = b"TXXX" + (11).to_bytes(4, "big") + b"\0\0" + b"\0unit\x00" + b"576\0\0"
    tag = b"ID3\x03\0\0" + bytes((len(text) >> s) & 127 for s in (21, 14, 7, 0)) + text
    return tag + xing + frames + b"TAG".ljust(125, b"\0") + bytes([0, 0, 255])


def tag_frames(body: bytes, version: int) -> dict[str, str]:
    """The text frames of an ID3v2.3 or 2.4 tag by their names; user text is named by its description."""
    out, at = {}, 0
    shift = 7 if version == 4 else 8
    while version in (3, 4) and at + 10 <= len(body) and body[at : at + 1] != b"\0":
        name, size = body[at : at + 4].decode("latin-1"), sum(b << shift * k for k, b in enumerate(reversed(body[at + 4 : at + 8])))
        raw, at = body[at + 10 : at + 10 + size], at + 10 + size
        if name[0] == "T" and raw:
            value = raw[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1"), "replace")
            if name == "TXXX":
                described, _, value = value.partition("\0")
                name = f"TXXX:{described}"
            out[name] = value.rstrip("\0")
    return out


def scan(stream: bytes, keep: bool = True) -> dict:
    """What a stream holds: tags, table, duration, frame offsets, faults and the stored bytes."""
    at, end, tags, texts = 0, len(stream), [], {}
    while stream[at : at + 3] == b"ID3" and at + 10 <= end:
        size = 0
        for b in stream[at + 6 : at + 10]:
            size = size << 7 | b & 127
        tags.append(f"id3v2.{stream[at + 3]}")
        texts |= tag_frames(stream[at + 10 : at + 10 + size], stream[at + 3])
        at = min(end, at + 10 + size + 10 * (stream[at + 5] >> 4 & 1))
    if end - at >= 128 and stream[end - 128 : end - 125] == b"TAG":
        tags.append("id3v1")
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if value := stream[end - 128 + lo : end - 128 + hi].split(b"\0")[0].decode("latin-1").strip():
                texts[f"id3v1.{name}"] = value
        end -= 128
    offsets, lengths, rates, skipped, bad, samples, table, out = [], [], set(), 0, 0, Counter(), None, []
    while at + 4 <= end:
        h = stream[at : at + 4]
        n = frame_length(h)
        side = SIDE_MONO if h[3] >> 6 == 3 else SIDE_STEREO
        protected = not h[1] & 1
        body = at + 4 + 2 * protected + side
        sound = bool(n) and protected and _crc(h[2:4] + stream[at + 6 : body]) == int.from_bytes(stream[at + 4 : at + 6], "big")
        # A frame counts if another header follows it, if it ends the stream, or if its checksum holds.
        if not n or at + n > end or not (sound or at + n + 4 > end or frame_length(stream[at + n : at + n + 4])):
            nxt = stream.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        if protected and not sound:
            bad += 1
        if not offsets and table is None and stream[at + 36 : at + 40] == b"VBRI" and at + 54 <= at + n:
            # Fixed places of the format: bytes at 10, frames at 14 behind the mark.
            table = {"bytes": int.from_bytes(stream[at + 46 : at + 50], "big"), "frames": int.from_bytes(stream[at + 50 : at + 54], "big"), "toc": b""}
        elif not offsets and table is None and stream[body : body + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(stream[body + 4 : body + 8], "big"), body + 8
            table = {"frames": None, "bytes": None, "toc": b""}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name], p = int.from_bytes(stream[p : p + 4], "big"), p + 4
            if flags & 4:
                table["toc"] = stream[p : p + 100]
        else:
            offsets.append(at)
            lengths.append(n)
            rates.add(BITRATES[h[2] >> 4])
            samples[RATES[h[2] >> 2 & 3]] += SAMPLES
            if keep:
                out.append(stream[body : body + UNIT])
        at += n
    skipped += end - at
    # Samples are added up by rate; only the sum over all is cut to whole microseconds.
    duration = int(sum(Fraction(n * 1_000_000, rate) for rate, n in samples.items()))
    return {
        "tags": tags, "table": table, "frames": len(offsets), "offsets": offsets, "lengths": lengths, "bitrates": sorted(rates), "duration_us": duration, "samples": dict(samples), "tag_texts": texts,
        "skipped": skipped, "bad_checksums": bad, "table_fits": bool(table) and table["frames"] == len(offsets), "payload": b"".join(out),
    }


def encode_media(df: DataFrame, column: str = "text") -> DataFrame:
    """``df``'s key ``doc_id`` with n_bytes and the stored form ``media`` of a text column.

    A null text is empty; a payload is never empty, so every row has a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Slices bound what a batch of long texts takes.
            for lo, hi in _slices(b.column(1)):
                raw = [(x or "").encode() for x in b.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield lo, i
            lo, size = i, 0
        size += n or 0
    if lo < len(texts):
        yield lo, len(texts)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_offsets array<long>"


def scan_media(df: DataFrame) -> DataFrame:
    """Features of ``media``, with the offset of every frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _FEATURES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for doc_id, n, media in zip(*(c for c in b.columns)):
                m = media.as_py()
                s = scan(m)
                p = s["payload"]
                off = hashlib.sha256(np.array(s["offsets"], np.int64).tobytes()).hexdigest()[:16]
                feature = f"frames={s['frames']};duration_us={s['duration_us']};kbps={'/'.join(map(str, s['bitrates']))};tags={'+'.join(s['tags'])};table={'fits' if s['table_fits'] else 'no'};bad_crc={s['bad_checksums']};skipped={s['skipped']};offsets={off}"
                rows.append((doc_id.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, s["duration_us"], s["offsets"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)


def op7_media(docs: DataFrame) -> DataFrame:
    """The features of every row's text as a stream, read back from its bytes.

    A null text is empty; an empty one has one frame of padding.  Equal texts give equal values; rows that repeat a doc_id are rows of their
    own and a null doc_id stays null.  Texts of any length are stored whole.  An empty table gives an empty one.  Columns but doc_id and text don't matter.
    """
    return scan_media(encode_media(docs))
