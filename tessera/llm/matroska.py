"""Matroska files in binary columns: written from samples, parsed into packet tables.

``store`` writes the bytes of a text column as 8-bit PCM: an EBML header, segment information, one
audio track, clusters of laced SimpleBlocks and cues. ``packets`` parses any Matroska column into
rows of track, timestamp and byte range, and ``features`` reads the samples back from those ranges.

Parsing covers variable-length ids and sizes, unknown sizes of segments and clusters, SimpleBlocks
and BlockGroups, all four kinds of lacing (none, Xiph, EBML, fixed) and cues.

Edge cases: null text is stored as empty, and empty text as 64 zero bytes; equal texts give equal
files; a file that can't be parsed, or whose numbers pass 64 bits, gives one row with ``error`` set and
no packets; null ids are given back as null, and rows that share an id are files of their own; very long
texts are one file each; an empty table gives an empty result; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import slices, strings

# fixed values: element ids of the format
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA1
NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION, RATE, CHANNELS, DEPTH = 0xD7, 0x83, 0x86, 0x23E383, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

UNKNOWN = -1
ALIGN = 64


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all value bits set is reserved for unknown sizes."""
    n = width or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace_sizes(sizes: list[int]) -> tuple[int, bytes]:
    """The lacing flag bits of frames with these sizes, and the header that goes before them."""
    if len(sizes) == 1:
        return 0, b""
    if len(set(sizes)) == 1:
        return 0b100, bytes([len(sizes) - 1])
    head = bytes([len(sizes) - 1]) + vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        d = b - a
        n = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1))
        head += vint(d + (1 << 7 * n - 1) - 1, n)
    return 0b110, head


def write(samples: bytes, rate: int = 8000, frame: int = 1024, frames: int = 8, blocks: int = 8) -> bytes:
    """A file with one 8-bit track: ``frame`` samples a frame, ``frames`` a block, ``blocks`` a cluster."""
    step = frame * 1000 // rate
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(0x4D80, b"tessera") + element(0x5741, b"tessera"))
    audio = element(AUDIO, element(RATE, np.array(rate, ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = number(NUMBER, 1) + number(0x73C5, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    span = frame * frames
    for k in range(0, len(samples), span * blocks):
        time = k // frame * step
        inside = [number(TIMESTAMP, time)]
        for b in range(k, min(k + span * blocks, len(samples)), span):
            data = samples[b : b + span]
            whole, rest = divmod(len(data), frame)
            flag, laced = lace_sizes([frame] * whole + [rest] * bool(rest))
            relative = b // frame * step - time
            inside.append(element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big") + bytes([0x80 | flag]) + laced + data))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(inside)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds; a packet is (track, cluster, timestamp in ns, start, length, lace, keyframe)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position
    clusters: list[int] = field(default_factory=list)  # position in the segment


def read_vint(raw: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    if at >= end or not raw[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - raw[at].bit_length()
    if at + n > end:
        raise ValueError(f"integer cut off at byte {at}")
    value = int.from_bytes(raw[at : at + n], "big")
    if not keep_marker:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = UNKNOWN
    return value, at + n


def children(raw: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int, int]]:
    """Elements between two bytes: id, where its header begins, where its body begins and ends."""
    while at < end:
        head = at
        kind, at = read_vint(raw, at, end, keep_marker=True)
        size, at = read_vint(raw, at, end)
        stop = at + size
        if size == UNKNOWN:
            if kind not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {kind:#x} has no size")
            stop = end if kind == SEGMENT else unknown_end(raw, at, end)
        if stop > end:
            raise ValueError(f"element {kind:#x} at byte {head} passes the end of its parent")
        yield kind, head, at, stop
        at = stop


def unknown_end(raw: bytes, at: int, end: int) -> int:
    """A cluster without size ends before the next element of its level."""
    while at < end:
        kind, body = read_vint(raw, at, end, keep_marker=True)
        if kind in TOP:
            return at
        size, body = read_vint(raw, body, end)
        if size == UNKNOWN:
            raise ValueError(f"element {kind:#x} has no size")
        at = body + size
    return end


def parse(raw: bytes) -> Media:
    out = Media()
    first = True
    for kind, _, at, end in children(raw, 0, len(raw), 0):
        if first and kind != EBML:
            raise ValueError("no EBML header")
        first = False
        if kind == SEGMENT:
            segment(raw, at, end, out)
    if first:
        raise ValueError("no EBML header")
    return out


def uint(raw: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise ValueError(f"integer of {end - at} bytes at byte {at}")
    return int.from_bytes(raw[at:end], "big")


def segment(raw: bytes, begin: int, stop: int, out: Media) -> None:
    for kind, head, at, end in children(raw, begin, stop, SEGMENT):
        if kind == INFO:
            for k, _, a, e in children(raw, at, end, kind):
                if k == SCALE:
                    out.scale = uint(raw, a, e)
        elif kind == TRACKS:
            for k, _, a, e in children(raw, at, end, kind):
                if k == TRACK_ENTRY:
                    entry = track(raw, a, e)
                    out.tracks[entry.get("number", 0)] = entry
        elif kind == CLUSTER:
            out.clusters.append(head - begin)
            cluster(raw, at, end, out)
        elif kind == CUES:
            for k, _, a, e in children(raw, at, end, kind):
                if k == CUE_POINT:
                    cue(raw, a, e, out)


def track(raw: bytes, at: int, end: int, inner: bool = False) -> dict:
    """Settings of a track entry, or of the audio element in one (``inner``), which holds no other."""
    got: dict = {}
    names = {NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration", CHANNELS: "channels", DEPTH: "depth"}
    for k, _, a, e in children(raw, at, end, TRACK_ENTRY):
        if k == AUDIO and not inner:
            got |= track(raw, a, e, inner=True)
        elif k in names:
            got[names[k]] = uint(raw, a, e)
        elif k == CODEC:
            got["codec"] = raw[a:e].decode("ascii", "replace")
        elif k == RATE:
            got["rate"] = float(np.frombuffer(raw[a:e], ">f8" if e - a == 8 else ">f4")[0]) if e - a in (4, 8) else 0.0
    return got


def cue(raw: bytes, at: int, end: int, out: Media) -> None:
    time, positions = 0, []
    for k, _, a, e in children(raw, at, end, CUE_POINT):
        if k == CUE_TIME:
            time = uint(raw, a, e)
        elif k == CUE_POSITIONS:
            got = {kk: uint(raw, aa, ee) for kk, _, aa, ee in children(raw, a, e, k)}
            positions.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
    out.cues += [(time, t, p) for t, p in positions]


def cluster(raw: bytes, begin: int, stop: int, out: Media) -> None:
    time, held = 0, []
    for k, _, a, e in children(raw, begin, stop, CLUSTER):
        if k == TIMESTAMP:
            time = uint(raw, a, e)
        elif k == SIMPLE_BLOCK:
            held.append((a, e, None))
        elif k == BLOCK_GROUP:
            inner = list(children(raw, a, e, k))
            key = not any(x[0] == 0xFB for x in inner)  # a block that refers to no other is a key frame
            held += [(x[2], x[3], key) for x in inner if x[0] == BLOCK]
    for a, e, key in held:
        block(raw, a, e, time, key, out)


def block(raw: bytes, at: int, end: int, time: int, key: bool | None, out: Media) -> None:
    number_, at = read_vint(raw, at, end)
    if at + 3 > end:
        raise ValueError(f"block cut off at byte {at}")
    relative = int.from_bytes(raw[at : at + 2], "big", signed=True)
    flags = raw[at + 2]
    at += 3
    sizes, at = laced(raw, at, end, flags >> 1 & 3)
    step = out.tracks.get(number_, {}).get("duration", 0)
    begin = (time + relative) * out.scale
    if not -(1 << 63) <= begin <= begin + (len(sizes) - 1) * step < 1 << 63:
        raise ValueError(f"timestamp out of range in the block before byte {at}")
    for i, n in enumerate(sizes):
        out.packets.append((number_, len(out.clusters) - 1, begin + i * step, at, n, i, bool(flags & 0x80) if key is None else key))
        at += n


def laced(raw: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The frame sizes of a block, and where the first frame begins."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise ValueError(f"lacing cut off at byte {at}")
    n = raw[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:  # fixed
        if (end - at) % n:
            raise ValueError("frames of fixed lacing differ in size")
        return [(end - at) // n] * n, at
    if kind == 1:  # Xiph: sums of bytes up to one below 255
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"lacing cut off at byte {at}")
                size += raw[at]
                at += 1
                if raw[at - 1] != 255:
                    break
            sizes.append(size)
    elif n > 1:  # EBML: the first size, then signed differences
        size, at = read_vint(raw, at, end)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            d, at = read_vint(raw, at, end)
            bits = 7 * (at - before)
            d = (1 << bits) - 1 if d == UNKNOWN else d
            sizes.append(sizes[-1] + d - ((1 << bits - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced frames pass the end of their block")
    return [*sizes, last], at


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % ALIGN if text else ALIGN)


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's bytes, padded, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                raw, at = strings(batch.column(1))
                texts = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array([write(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKET = "doc_id long, track long, cluster int, timestamp_ns long, start long, length long, lace int, keyframe boolean, error string"


def packets(media: DataFrame, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each packet of each file: track, timestamp and byte range in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("cluster", pa.int32()), ("timestamp_ns", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("lace", pa.int32()), ("keyframe", pa.bool_()), ("error", pa.string())])
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        rows += [(d, *p, None) for p in parse(raw or b"").packets]
                    except ValueError as e:
                        rows.append((d, None, None, None, None, None, None, None, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return media.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("media")).mapInArrow(run, PACKET)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(media: DataFrame, doc_id: str = "doc_id", n_bytes: str = "n_bytes", column: str = "media") -> DataFrame:
    """Digests and features of the samples, read back through the packet table of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                got = [_digest(raw or b"") for raw in batch.column(2).to_pylist()]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select(F.col(doc_id).alias("doc_id"), F.col(n_bytes).alias("n_bytes"), F.col(column).alias("media")).mapInArrow(run, FEATURES)


def _digest(raw: bytes) -> tuple:
    try:
        got = parse(raw)
    except ValueError as e:
        return None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), None, str(e)
    payload = b"".join([raw[s : s + n] for _, _, _, s, n, _, _ in got.packets])
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    total, squares = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    n = max(1, len(x))
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    at = {c: i for i, c in enumerate(got.clusters)}
    sound = sum(p in at for _, _, p in got.cues)
    end = max((p[2] for p in got.packets), default=0) // 1_000_000
    mean, power = total / n, squares / n
    text = f"tracks={len(got.tracks)};clusters={len(got.clusters)};packets={len(got.packets)};cues={sound};last_ms={end};peak={int(x.max()) if len(x) else 0};mean={mean:.3f};rms={power ** 0.5:.3f};crossings={turns};levels={int((counts > 0).sum())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(raw), hashlib.sha256(raw).hexdigest(), text, None
