"""Media columns: Matroska files as binary values, and their packet tables.

parse() reads EBML's variable-length elements, of known and unknown size, clusters, simple blocks
and block groups, all four lacings and cues, and gives a row per packet with its track, time and
byte range. mux() writes a payload as 8-bit PCM audio with laced blocks and cues; it serves to store
bytes losslessly and as the round trip that tests the parser.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import documents, release

# Element ids of the public Matroska specification (fixed values).
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

LACINGS = ("none", "xiph", "fixed", "ebml")
SAMPLE_RATE, UNIT, BLOCK_BYTES, CLUSTER_BLOCKS = 8000, 64, 2048, 32


class MatroskaError(ValueError):
    pass


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    length: int
    cluster: int
    block: int
    lacing: str
    keyframe: bool


class Media(NamedTuple):
    doctype: str
    duration_ns: int | None
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, offset of the cluster


def _number(data, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, place after it, whether all value bits are ones) of a variable-length number."""
    if at >= end:
        raise MatroskaError("number past the end")
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > end:
        raise MatroskaError("bad variable-length number")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << (7 * n)) - 1)
    return (raw if keep_marker else value), at + n, value == (1 << (7 * n)) - 1


#: Where an element of unknown size ends: at the first id that cannot be inside it.
_LEVEL1 = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469))


def elements(data, at: int, end: int, outside: frozenset = frozenset()) -> Iterator[tuple[int, int, int, int, bool]]:
    """(id, start of the element, start and end of its data, whether its size is unknown)."""
    while at < end:
        start = at
        key, at, _ = _number(data, at, end, True)
        if key in outside:
            return
        size, at, unknown = _number(data, at, end, False)
        stop = end if unknown else at + size
        if stop > end:
            raise MatroskaError(f"element {key:x} runs past its parent")
        yield key, start, at, stop, unknown
        at = stop if not unknown else _extent(data, at, end, key)


def _extent(data, at: int, end: int, key: int) -> int:
    """End of an element of unknown size."""
    if key == CLUSTER:
        while at < end:
            start = at
            child, at, _ = _number(data, at, end, True)
            if child in _LEVEL1:
                return start
            size, at, _ = _number(data, at, end, False)
            at += size
        return min(at, end)
    return end


def _uint(data, s: int, e: int) -> int:
    return int.from_bytes(data[s:e], "big")


def _float(data, s: int, e: int) -> float:
    if e - s not in (0, 4, 8):
        raise MatroskaError(f"a float of {e - s} bytes")
    value = struct.unpack({0: ">0s", 4: ">f", 8: ">d"}[e - s], bytes(data[s:e]))[0] if e > s else 0.0
    if not math.isfinite(value):
        raise MatroskaError("a float that is no number")
    return value


def _laces(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, length) of a block's packets."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError("lacing without a count")
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise MatroskaError("fixed lacing of unequal packets")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        if kind == 1:
            for _ in range(n - 1):
                size = 0
                while True:
                    if at >= end:
                        raise MatroskaError("lacing past the block")
                    b, at = data[at], at + 1
                    size += b
                    if b != 255:
                        break
                sizes.append(size)
        else:
            for i in range(n - 1):
                width = 9 - data[at].bit_length() if at < end else 9
                value, at, _ = _number(data, at, end, False)
                sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise MatroskaError("lacing past the block")
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return found


def parse(data: bytes) -> Media:
    """The file's tracks, packets and cues; raises MatroskaError where the bytes are no Matroska.

    Packets of a laced block follow each other by the track's default duration or, for PCM, by their
    samples; a track that gives neither (or a rate or channels of 0) has them all at the block's time.
    """
    doctype, scale, duration, tracks, packets, cues = "", 1_000_000, None, {}, [], []
    clusters = blocks = 0
    segment_at = None

    def track_entry(s: int, e: int) -> None:
        t = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "default_ns": 0}
        for key, _, a, b, _ in elements(data, s, e):
            if key == TRACK_NUMBER:
                t["number"] = _uint(data, a, b)
            elif key == TRACK_TYPE:
                t["type"] = _uint(data, a, b)
            elif key == CODEC:
                t["codec"] = bytes(data[a:b]).rstrip(b"\0").decode("ascii", "replace")
            elif key == DEFAULT_DURATION:
                t["default_ns"] = _uint(data, a, b)
            elif key == AUDIO:
                for k, _, x, y, _ in elements(data, a, b):
                    if k == RATE:
                        t["rate"] = _float(data, x, y)
                    elif k == CHANNELS:
                        t["channels"] = _uint(data, x, y)
                    elif k == BIT_DEPTH:
                        t["bits"] = _uint(data, x, y)
        tracks[t["number"]] = t

    def block(s: int, e: int, base: int, simple: bool, keyframe: bool) -> None:
        nonlocal blocks
        track, at, _ = _number(data, s, e, False)
        if at + 3 > e:
            raise MatroskaError("short block")
        relative, flags = struct.unpack(">hB", bytes(data[at : at + 3]))
        kind = flags >> 1 & 3
        t = tracks.get(track, {})
        when = (base + relative) * scale
        for offset, length in _laces(data, at + 3, e, kind):
            packets.append(Packet(track, when, offset, length, clusters, blocks, LACINGS[kind], bool(flags & 0x80) if simple else keyframe))
            if t.get("default_ns"):
                when += t["default_ns"]
            elif t.get("codec", "").startswith("A_PCM") and t["bits"] > 0 and t["channels"] > 0 and t["rate"] > 0:
                when += round(length * 8 / (t["bits"] * t["channels"]) / t["rate"] * 1e9)
        blocks += 1

    for key, _, s, e, _ in elements(data, 0, len(data)):
        if key == EBML:
            for k, _, a, b, _ in elements(data, s, e):
                if k == DOCTYPE:
                    doctype = bytes(data[a:b]).rstrip(b"\0").decode("ascii", "replace")
        elif key == SEGMENT:
            segment_at = s
            for k, _, a, b, unknown in elements(data, s, e):
                if k == INFO:
                    for x, _, p, q, _ in elements(data, a, b):
                        if x == TIMESTAMP_SCALE:
                            scale = _uint(data, p, q)
                        elif x == DURATION:
                            duration = _float(data, p, q)
                elif k == TRACKS:
                    for x, _, p, q, _ in elements(data, a, b):
                        if x == TRACK:
                            track_entry(p, q)
                elif k == CLUSTER:
                    base = 0
                    for x, _, p, q, _ in elements(data, a, b, _LEVEL1 if unknown else frozenset()):
                        if x == CLUSTER_TIME:
                            base = _uint(data, p, q)
                        elif x == SIMPLE_BLOCK:
                            block(p, q, base, True, False)
                        elif x == BLOCK_GROUP:
                            inner = [*elements(data, p, q)]
                            for y, _, u, v, _ in inner:
                                if y == BLOCK:
                                    block(u, v, base, False, all(z[0] != REFERENCE for z in inner))
                    clusters += 1
                elif k == CUES:
                    for x, _, p, q, _ in elements(data, a, b):
                        if x == CUE_POINT:
                            when = 0
                            for y, _, u, v, _ in elements(data, p, q):
                                if y == CUE_TIME:
                                    when = _uint(data, u, v)
                                elif y == CUE_POSITIONS:
                                    spot = {z: _uint(data, m, n) for z, _, m, n, _ in elements(data, u, v)}
                                    cues.append((when * scale, spot.get(CUE_TRACK, 0), spot.get(CUE_CLUSTER, 0) + s))
    if segment_at is None or not doctype:
        raise MatroskaError("no EBML header and segment")
    return Media(doctype, None if duration is None else round(duration * scale), tracks, packets, cues)


def _size(n: int) -> bytes:
    width = max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _whole(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_lace(delta: int) -> bytes:
    for width in range(1, 9):
        bias = (1 << (7 * width - 1)) - 1
        if -bias <= delta <= bias:
            return (delta + bias | 1 << (7 * width)).to_bytes(width, "big")
    raise MatroskaError("packet too large")


def _split(n: int, kind: int) -> list[int]:
    """Packet sizes, multiples of UNIT, that n bytes of a block get under a lacing."""
    units = n // UNIT
    if kind == 0 or units < 2:
        return [n]
    if kind == 2:
        parts = next(p for p in (8, 4, 2, 1) if units % p == 0)
        return [n // parts] * parts
    sizes, step = [], 1
    while units > 0:
        take = min(units, 1 + step % 3 if kind == 1 else 1 + step % 4)
        sizes.append(take * UNIT)
        units, step = units - take, step + 1
    return sizes


def _block(payload: bytes, relative: int, kind: int) -> bytes:
    sizes = _split(len(payload), kind)
    if len(sizes) == 1:
        kind = 0
    head = b"\x81" + struct.pack(">hB", relative, 0x80 | kind << 1)
    if kind:
        head += bytes([len(sizes) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += _size(sizes[0]) + b"".join(_signed_lace(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + payload


_HEADER = _element(EBML, _whole(0x4286, 1) + _whole(0x42F7, 1) + _whole(0x42F2, 4) + _whole(0x42F3, 8) + _element(DOCTYPE, b"matroska") + _whole(0x4287, 4) + _whole(0x4285, 2))
_AUDIO_TRACK = _element(TRACKS, _element(TRACK, _whole(TRACK_NUMBER, 1) + _whole(TRACK_UID, 1) + _whole(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + _whole(CHANNELS, 1) + _whole(BIT_DEPTH, 8))))


def pad(payload: bytes) -> bytes:
    """payload with zero bytes up to a positive multiple of UNIT."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one track, 8-bit PCM at 8 kHz, holds payload sample by byte.

    len(payload) is a positive multiple of 64, so that packets begin at whole milliseconds. Lacings
    alternate from block to block; every fourth block is a block group; each cluster has a cue.
    """
    if not payload or len(payload) % UNIT:
        raise MatroskaError("the payload is no positive multiple of 64 bytes")
    per_ms = SAMPLE_RATE // 1000
    info = _element(INFO, _whole(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) / per_ms)) + _element(0x4D80, b"sievework") + _element(0x5741, b"sievework"))
    body, cues, at = [info, _AUDIO_TRACK], [], len(info) + len(_AUDIO_TRACK)
    span = BLOCK_BYTES * CLUSTER_BLOCKS
    for c in range(0, len(payload), span):
        inner = [_whole(CLUSTER_TIME, c // per_ms)]
        for i, s in enumerate(range(c, min(c + span, len(payload)), BLOCK_BYTES)):
            part = payload[s : s + BLOCK_BYTES]
            raw = _block(part, (s - c) // per_ms, (2, 1, 3, 0)[i % 4])
            inner.append(_element(SIMPLE_BLOCK, raw) if i % 4 < 3 else _element(BLOCK_GROUP, _element(BLOCK, bytes([*raw[:3], raw[3] & 0x7F]) + raw[4:]) + _whole(BLOCK_DURATION, len(part) // per_ms)))
        cluster = _element(CLUSTER, b"".join(inner))
        cues.append(_element(CUE_POINT, _whole(CUE_TIME, c // per_ms) + _element(CUE_POSITIONS, _whole(CUE_TRACK, 1) + _whole(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(body))


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes, padded, as a Matroska file; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], type=pa.int64()), pa.array([mux(pad(x)) for x in raw], type=pa.binary())], names=["id", "n_bytes", "media"])
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_bytes long, media binary")


def packet_table(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row per packet: id, track, timestamp_ns, byte_offset, byte_length, cluster, block, lacing, keyframe, error.

    A value that is null or no Matroska gives one row with its error and nulls; a file without packets
    gives none. Rows that share an id keep their own packets. Other columns play no part.
    """
    names = ["id", "track", "timestamp_ns", "byte_offset", "byte_length", "cluster", "block", "lacing", "keyframe", "error"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(key, *p, None) for p in parse(data or b"").packets]
                except MatroskaError as e:
                    rows.append((key, *[None] * 8, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k or b.schema.field(0).type) for c, k in zip(cols, kinds, strict=True)], names=names)
        release()

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, track long, timestamp_ns long, byte_offset long, byte_length long, cluster long, block long, lacing string, keyframe boolean, error string")


def feature(media: Media, samples: np.ndarray) -> str:
    """One line on the file's structure and its samples; of a file without packets, on its structure alone."""
    laces = {k: 0 for k in LACINGS}
    for p in media.packets:
        laces[p.lacing] += 1
    first, last = (media.packets[0], media.packets[-1]) if media.packets else (None, None)
    t = media.tracks.get(first.track if first else min(media.tracks, default=0), {"codec": "", "rate": 0.0, "bits": 0})
    x = samples.astype(np.float64) - 128
    heard = f";mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())}" if x.size else ""
    return (
        f"codec={t['codec']};rate={t['rate']:g};bits={t['bits']};clusters={last.cluster + 1 if last else 0};blocks={last.block + 1 if last else 0};packets={len(media.packets)};"
        + ";".join(f"{k}={n}" for k, n in laces.items())
        + f";cues={len(media.cues)};ms={(media.duration_ns or 0) // 1_000_000};last_ms={last.timestamp_ns // 1_000_000 if last else 0}" + heard
    )


def media_features(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Digests of the payload that the packets' byte ranges give back, and of the file itself; one row per row.

    df also has n_bytes, which passes. A value that is null or no Matroska has its error in the column
    error and nulls elsewhere; a file without packets has an empty payload. Other columns play no part.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    media = parse(data or b"")
                except MatroskaError as e:
                    rows.append((n, *[None] * 6, str(e)))
                    continue
                payload = b"".join([data[p.offset : p.offset + p.length] for p in media.packets])
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, np.frombuffer(payload, dtype=np.uint8)), None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])
        release()

    return df.select(F.col(id_col).alias("id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col(media_col).alias("media")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a Matroska file, and what its packets give back; null and empty texts are 64 zero bytes."""
    return media_features(media_column(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")
