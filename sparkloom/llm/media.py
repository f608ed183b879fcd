"""ISO media containers for binary columns: a writer and a box walker.

The writer stores a payload losslessly as uncompressed 8-bit pictures: one track
with the sample entry ``raw `` and a sample for each picture.  Key frames are the
first picture, every one whose histogram of high half-bytes differs from that of
the picture before it in over ``CHANGE`` of its bytes, and the ``GOP``-th after a
key frame at the latest.  The walker reads any nested boxes, decodes the sample
tables (stts, stsz, stsc, stco/co64, stss) and fragments (trex, tfhd, trun), and
derives codec, duration and the byte range of every key frame from them; it never
touches the payload.  ``payload`` copies the samples' ranges out.

Defined results: a null or empty text is one picture of padding bytes; texts may
be of any length; equal texts give equal files; anything that is not a well-formed
file (a truncated box, boxes nested over ``DEPTH`` deep, tables that disagree or
point outside the file) raises ValueError; an empty table gives an empty table;
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

SIDE, FRAME, PAD, SCALE, TICKS = 24, 576, 255, 25, 1
PER_CHUNK = 32
GOP, CHANGE, DEPTH = 24, 0.25, 32
#: Boxes that hold boxes, as the ISO base media file format names them.
NESTING = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"udta"}
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, media binary, codec string, duration_ms long, n_samples long, key_ranges array<struct<offset:long,size:long>>"


def box(kind: bytes, *body: bytes) -> bytes:
    inner = b"".join(body)
    if len(inner) + 8 < 1 << 32:
        return struct.pack(">I4s", len(inner) + 8, kind) + inner
    return struct.pack(">I4sQ", 1, kind, len(inner) + 16) + inner


def full(kind: bytes, *body: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, frame: int = FRAME) -> bytes:
    """Bytes PAD up to a positive multiple of ``frame``."""
    return data + bytes([PAD]) * (-len(data) % frame or (0 if data else frame))


def key_frames(payload: bytes, frame: int = FRAME) -> list[int]:
    """Numbers (from 1) of the samples that begin something new."""
    high = (np.frombuffer(payload, dtype=np.uint8) >> 4).reshape(-1, frame)
    n = len(high)
    bins = np.bincount((np.arange(n)[:, None] * 16 + high).ravel(), minlength=16 * n).reshape(n, 16)
    moved = np.abs(np.diff(bins, axis=0)).sum(axis=1) > 2 * CHANGE * frame
    out = [1]
    for k in range(2, n + 1):
        if moved[k - 2] or k - out[-1] >= GOP:
            out.append(k)
    return out


def write(payload: bytes, frame: int = FRAME, side: int = SIDE, keys: list[int] | None = None) -> bytes:
    """A file of len(payload) / frame samples; ``keys``: numbers (from 1) of the key frames, all when None."""
    n = len(payload) // frame
    if n * frame != len(payload) or not n:
        raise ValueError("the payload must be a positive multiple of the frame size")
    ticks = n * TICKS
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    chunks = -(-n // PER_CHUNK)
    stsc = [(1, min(n, PER_CHUNK), 1)]
    if n > PER_CHUNK and n % PER_CHUNK:
        stsc.append((chunks, n % PER_CHUNK, 1))

    def moov(first: int) -> bytes:
        offsets = [first + k * PER_CHUNK * frame for k in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        entry = box(
            b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", side, side, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1)
        )  # 8 bits a sample
        table = [
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full(b"stsz", struct.pack(">II", frame, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
        ]
        if keys is not None:
            table.append(full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)))
        minf = box(
            b"minf",
            full(b"vmhd", bytes(8), flags=1),
            box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))),
            box(b"stbl", *table),
        )
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, SCALE, ticks, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(16), _MATRIX, struct.pack(">II", side << 16, side << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, SCALE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    gap = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    size = len(moov(len(head) + size + gap))  # 64-bit offsets may have made it longer
    return head + moov(len(head) + size + gap) + box(b"mdat", payload)


@dataclass(frozen=True)
class Box:
    kind: bytes
    path: tuple[bytes, ...]
    start: int
    end: int


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[Box]:
    """All boxes in file order, parents first; start and end are those of the content."""
    if len(path) > DEPTH:
        raise ValueError("boxes are nested too deep")
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or body > start + size:
            raise ValueError(f"box {kind!r} reaches past its parent")
        yield Box(kind, path, body, start + size)
        if kind in NESTING:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


@dataclass(frozen=True)
class Track:
    codec: str
    timescale: int
    duration: int
    samples: list[tuple[int, int]]
    keys: list[int]

    @property
    def duration_ms(self) -> int:
        return self.duration * 1000 // self.timescale


def _read(form: str, data: bytes, b: Box, at: int) -> tuple:
    """Numbers at a place in a box, which must hold them."""
    if b.start + at + struct.calcsize(">" + form) > b.end:
        raise ValueError(f"box {b.kind!r} is cut off")
    return struct.unpack_from(">" + form, data, b.start + at)


def _numbers(data: bytes, b: Box, form: str, skip: int = 8) -> list[tuple]:
    (count,) = _read("I", data, b, skip - 4)
    if b.start + skip + count * struct.calcsize(">" + form) > b.end:
        raise ValueError(f"table {b.kind!r} is cut off")
    return list(struct.iter_unpack(">" + form, data[b.start + skip : b.start + skip + count * struct.calcsize(">" + form)]))


def _table(data: bytes, t: dict[bytes, Box]) -> tuple[list[tuple[int, int]], list[int], int]:
    """Samples (place, size), numbers of key frames and ticks of a track's sample table."""
    ticks = sum(n * step for n, step in _numbers(data, t[b"stts"], "II"))
    same, count = _read("II", data, t[b"stsz"], 4)
    if same and same * count > len(data):
        raise ValueError("there are more samples than bytes")
    sizes = [same] * count if same else [x[0] for x in _numbers(data, t[b"stsz"], "I", 12)]
    places = [x[0] for x in (_numbers(data, t[b"co64"], "Q") if b"co64" in t else _numbers(data, t[b"stco"], "I"))]
    runs = _numbers(data, t[b"stsc"], "III")
    samples: list[tuple[int, int]] = []
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(places) + 1
        if not 1 <= first <= last <= len(places) + 1:
            raise ValueError("a run of chunks points outside the chunks")
        for where in places[first - 1 : last - 1]:
            for size in sizes[len(samples) : len(samples) + per]:
                samples.append((where, size))
                where += size
    if len(samples) != len(sizes):
        raise ValueError("the sample tables do not agree")
    keys = [x[0] for x in _numbers(data, t[b"stss"], "I")] if b"stss" in t else list(range(1, len(samples) + 1))
    if any(not 1 <= k <= len(samples) for k in keys):
        raise ValueError("a key frame is no sample")
    return samples, keys, ticks


def _optional(data: bytes, b: Box, at: int, flags: int, *fields: tuple[int, str, str]) -> tuple[dict[str, int], int]:
    """The fields of a box whose bit is set in its flags, and where they end."""
    out = {}
    for bit, name, form in fields:
        if flags & bit:
            (out[name],) = _read(form, data, b, at)
            at += struct.calcsize(">" + form)
    return out, at


def _fragment(data: bytes, moof: int, tfhd: Box, truns: list[Box], extends: dict[int, tuple]) -> tuple[int, list[tuple[int, int, bool]], int]:
    """Track id, samples (place, size, whether a key frame) and ticks of a track fragment."""
    flags, track = _read("II", data, tfhd, 0)
    head, _ = _optional(data, tfhd, 8, flags, (1, "base", "Q"), (2, "entry", "I"), (8, "duration", "I"), (16, "size", "I"), (32, "flags", "I"))
    usual = dict(zip(("duration", "size", "flags"), extends.get(track, (0, 0, 0)), strict=True)) | head
    where, ticks = head.get("base", moof), 0
    samples = []
    for run in truns:
        flags, count = _read("II", data, run, 0)
        if count > len(data):
            raise ValueError("there are more samples than bytes")
        own, at = _optional(data, run, 8, flags, (1, "offset", "i"), (4, "flags", "I"))
        where = head.get("base", moof) + own["offset"] if "offset" in own else where
        for k in range(count):
            s, at = _optional(data, run, at, flags, (0x100, "duration", "I"), (0x200, "size", "I"), (0x400, "flags", "I"), (0x800, "shift", "I"))
            s = usual | ({"flags": own["flags"]} if not k and "flags" in own else {}) | s
            samples.append((where, s["size"], not s["flags"] & 0x10000))
            where += s["size"]
            ticks += s["duration"]
    return track, samples, ticks


def tracks(data: bytes) -> list[Track]:
    """Every track's samples, decoded from its tables and its fragments."""
    found: list[dict[bytes, Box]] = []
    extends: dict[int, tuple] = {}
    parts: list[tuple[int, Box, list[Box]]] = []
    moof = 0
    for b in walk(data):
        if b.kind == b"trak":
            found.append({})
        elif found and b"trak" in b.path:
            found[-1].setdefault(b.kind, b)
        elif b.kind == b"trex":
            _, track, _, *usual = _read("6I", data, b, 0)
            extends[track] = tuple(usual)
        elif b.kind == b"moof":
            moof = b.start - 8
        elif b.kind == b"tfhd":
            parts.append((moof, b, []))
        elif b.kind == b"trun" and parts:
            parts[-1][2].append(b)
    more: dict[int, list[tuple]] = {}
    for part in parts:
        track, *rest = _fragment(data, *part, extends)
        more.setdefault(track, []).append(rest)
    out = []
    for t in found:
        if not {b"tkhd", b"stsd", b"stts", b"stsc", b"stsz", b"mdhd"} <= t.keys() or not t.keys() & {b"stco", b"co64"}:
            raise ValueError("a track lacks a table")
        (codec,) = _read("4s", data, t[b"stsd"], 12)
        wide = _read("B", data, t[b"mdhd"], 0) == (1,)
        (scale,) = _read("I", data, t[b"mdhd"], 20 if wide else 12)
        (number,) = _read("I", data, t[b"tkhd"], 20 if _read("B", data, t[b"tkhd"], 0) == (1,) else 12)
        if not scale:
            raise ValueError("a track has no time scale")
        samples, keys, ticks = _table(data, t)
        for fragment, step in more.get(number, []):
            keys += [len(samples) + k for k, (_, _, key) in enumerate(fragment, 1) if key]
            samples += [(place, size) for place, size, _ in fragment]
            ticks += step
        if any(not 0 <= a <= a + n <= len(data) for a, n in samples):
            raise ValueError("a sample lies outside the file")
        out.append(Track(codec.decode("latin-1"), scale, ticks, samples, keys))
    return out


def payload(data: bytes, track: Track) -> bytes:
    view = memoryview(data)
    return b"".join(view[a : a + n] for a, n in track.samples)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media file, with what the walker reads from that file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    whole = padded(raw)
                    data = write(whole, keys=key_frames(whole))
                    (t,) = tracks(data)
                    keys = [{"offset": t.samples[k - 1][0], "size": t.samples[k - 1][1]} for k in t.keys]
                    rows.append((doc, len(raw), sum(n for _, n in t.samples), data, t.codec, t.duration_ms, len(t.samples), keys))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
                names = ["doc_id", "n_bytes", "payload_bytes", "media", "codec", "duration_ms", "n_samples", "key_ranges"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame) -> DataFrame:
    """Read the stored files back: digests of file and payload, and what the sample tables say as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                (t,) = tracks(data)
                back = payload(data, t)
                keys = [t.samples[k - 1] for k in t.keys]
                ranges = zlib.crc32(b"".join(struct.pack("<QQ", *x) for x in keys))
                feature = f"codec={t.codec.strip()};ms={t.duration_ms};samples={len(t.samples)};keys={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges={ranges}"
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
