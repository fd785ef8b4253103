"""MPEG audio as a media column: writing payloads into frames, and probing files of any origin.

`encode` stores bytes losslessly as a valid MPEG-1 layer III file: an ID3v2 tag, a frame with the variable-bitrate table
(Xing), silent frames protected by CRC-16 whose ancillary data carry the payload, and an ID3v1 tag. The bulk goes into
frames of the highest bitrate and the rest into the smallest frame that takes it, hence the variable bitrate.

`probe` reads a file without trusting it: it skips tags, resynchronises on frame headers (a header counts if the frame it
announces is followed by another header of the same stream, a tag or the end), checks CRCs of all layers, parses Xing/Info and VBRI
tables and the ID3v2 text frames, and returns exact durations (samples, rate, seconds) and the byte offset of every frame. The frame
that carries the table is no sound: it counts neither as a frame nor in the duration. Encoder delay and padding, where the table's
writer states them, are taken off the samples.

Defined cases: null text is empty; its payload is 64 zero bytes. Null media, or media without a frame, gives zero frames,
no payload and empty offsets. A payload length in a tag that isn't a whole number within the file gives no payload. Equal texts give equal files. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .support import fields, id_type, map_arrow

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), sampling rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE, SIDE = 32000, 17  # the stored stream: mono, 32 kHz, so that frame lengths are whole without padding
_HEAD = 4 + 2 + SIDE


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def stream(self) -> tuple:
        return self.version, self.layer, self.rate, self.mono


@lru_cache(4096)
def parse_header(word: bytes) -> Header | None:
    """The frame header of four bytes; None if they are none. Free-format streams count as none."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_index = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or word[3] & 3 == 2:
        return None
    kbps, rate, padding = BITRATES[version == 3, layer][index], RATES[version][rate_index], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padding
    return Header(version, layer, not word[1] & 1, kbps, rate, word[3] >> 6 == 3, size, samples)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the standard (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = c << 8 & 0xFFFF ^ _CRC[c >> 8 ^ b]
    return c


def _widths(h: Header) -> tuple[int, ...]:
    """Bits of the allocation of each subband, layers I and II."""
    if h.layer == 1:
        return (4,) * 32
    if h.version != 3:
        return (4,) * 4 + (3,) * 7 + (2,) * 19
    kbps = h.kbps if h.mono else h.kbps // 2
    if 56 <= kbps <= 80 or h.rate == 48000 and kbps >= 56:
        return (4,) * 11 + (3,) * 12 + (2,) * 4
    if kbps >= 96:
        return (4,) * 11 + (3,) * 12 + (2,) * 7
    return (4,) * 2 + (3,) * (6 if h.rate != 32000 else 10)


def checksum(frame: bytes, h: Header) -> int | None:
    """The CRC that a protected frame should have: over the header's last two bytes and the side information (layer III), the bit
    allocation (layer I), or the bit allocation and scfsi (layer II). None if the frame is too short to hold them."""
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side])
    bits, size, at, scfsi = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0, 0
    channels, mode = 1 if h.mono else 2, frame[3] >> 6
    bound = 4 * (frame[3] >> 4 & 3) + 4 if mode == 1 else 32
    for band, width in enumerate(_widths(h)):
        for _ in range(channels if band < bound else 1):  # above the bound both channels share one
            at += width
            if at > size:
                return None
            if bits >> size - at & (1 << width) - 1:
                scfsi += 2 * (channels if band >= bound else 1)
    at += scfsi if h.layer == 2 else 0
    if at > size:
        return None
    c = crc16(frame[2:4] + (bits >> size - at // 8 * 8).to_bytes(at // 8, "big"))
    for k in range(at // 8 * 8, at):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (bits >> size - 1 - k & 1) else 0)
    return c


@lru_cache(64)
def _frame_head(index: int) -> bytes:
    word = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(SIDE)
    return word + crc16(word[2:] + side).to_bytes(2, "big") + side


_SIZES = [0] + [144 * k * 1000 // RATE for k in BITRATES[True, 3][1:]]
_BULK = _SIZES[14] - _HEAD


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: str, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1")
    return name.encode() + len(body).to_bytes(4, "big") + b"\0\0" + body


def encode(payload: bytes) -> bytes:
    """A file whose frames carry payload in their ancillary data."""
    bulk, rest = divmod(len(payload), _BULK)
    indexes = [14] * bulk
    if rest:
        indexes.append(next(i for i in range(1, 15) if _SIZES[i] - _HEAD >= rest))
    table_index = next(i for i in range(1, 15) if _SIZES[i] - _HEAD >= 120)
    count = len(indexes)
    total = _SIZES[table_index] + sum(_SIZES[i] for i in indexes)
    body, at, starts = [], 0, []
    for k, i in enumerate(indexes):
        starts.append(_SIZES[table_index] + k * _SIZES[14])
        piece = payload[at : at + _SIZES[i] - _HEAD]
        at += len(piece)
        body += [_frame_head(i), piece]
        if len(piece) < _SIZES[i] - _HEAD:
            body.append(bytes(_SIZES[i] - _HEAD - len(piece)))
    toc = bytes(min(255, 256 * starts[p * count // 100] // total) for p in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    first = _frame_head(table_index) + table
    first += bytes(_SIZES[table_index] - len(first))
    tags = _text_frame("TLEN", str(count * 1152 * 1000 // RATE)) + _text_frame("TXXX", f"payload_bytes\0{len(payload)}")
    return b"".join([b"ID3\x03\0\0", _synchsafe(len(tags)), tags, first, *body, b"TAG", bytes(124), b"\xff"])


@dataclass
class Probe:
    frames: int = 0  # of sound, without the table's
    samples: int = 0  # without encoder delay and padding
    rate: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes between frames that belong to none
    kbps_min: int = 0
    kbps_max: int = 0
    table: str = ""  # Xing, Info or VBRI
    table_frames: int = -1
    table_bytes: int = -1
    toc: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    delay: int = 0
    padding: int = 0


def parse_id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2.3 or 2.4 tag and the tag's length."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return {}, 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end = min(len(data), 10 + size)
    at, tags, wide = 10, {}, data[3] >= 4
    if data[5] & 0x40 and at + 4 <= end:
        n = int.from_bytes(data[at : at + 4], "big")
        at += n if wide else n + 4
    while at + 10 <= end and data[at : at + 1].isalnum():
        raw = data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if wide else int.from_bytes(raw, "big")
        if n <= 0 or at + 10 + n > end:
            break
        name = data[at : at + 4].decode("latin-1")
        if name[0] == "T":
            kind, body = data[at + 10], data[at + 11 : at + 10 + n]
            text = body.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(kind, "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + n
    return tags, min(len(data), 10 + size + (10 if data[5] & 0x10 else 0))


def probe(data: bytes | None) -> Probe:
    out = Probe()
    if not data:
        return out
    out.tags, at = parse_id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        end = max(at, end - int.from_bytes(data[end - 20 : end - 16], "little") - (32 if data[end - 9] & 0x80 else 0))
    stream = None
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        good = h is not None and at + h.size <= end and (stream is None or h.stream == stream)
        if good and at + h.size + 4 <= end:
            after = parse_header(data[at + h.size : at + h.size + 4])
            good = after is not None and after.stream == h.stream
        if not good:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out.skipped += to - at
            at = to
            continue
        stream = h.stream
        if h.protected:
            out.crc_checked += 1
            out.crc_bad += checksum(data[at : at + h.size], h) != data[at + 4] << 8 | data[at + 5]
        first = not out.frames and not out.table
        if not (first and _read_table(data, at, h, out)):
            out.offsets.append(at)
            out.heads.append(h)
            out.frames += 1
            out.samples += h.samples
            out.kbps_min, out.kbps_max = min(out.kbps_min or h.kbps, h.kbps), max(out.kbps_max, h.kbps)
        at += h.size
    out.samples = max(0, out.samples - out.delay - out.padding)
    out.skipped += max(0, end - at)
    out.rate = stream[2] if stream else 0
    return out


def _read_table(data: bytes, at: int, h: Header, out: Probe) -> bool:
    """Reads the table of a stream's first frame; false if it has none."""
    if h.layer != 3:
        return False
    x, end = at + 4 + 2 * h.protected + h.side, at + h.size
    word = lambda p, n=4: int.from_bytes(data[p : p + n], "big")
    if data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= end:
        out.table, flags, p = data[x : x + 4].decode(), word(x + 4), x + 8
        if flags & 1:
            out.table_frames, p = word(p), p + 4
        if flags & 2:
            out.table_bytes, p = word(p), p + 4
        if flags & 4:
            out.toc, p = data[p : p + 100], p + 100
        p += 4 * bool(flags & 8)
        if p + 24 <= end and data[p : p + 4].isalnum():  # the writer's own part: nine bytes of name, and 12 bits each of delay and padding at byte 21
            out.delay, out.padding = word(p + 21, 3) >> 12, word(p + 21, 3) & 0xFFF
        return True
    v = at + 36
    if data[v : v + 4] == b"VBRI" and v + 26 <= end:
        out.table, out.delay = "VBRI", 0
        out.table_bytes, out.table_frames = word(v + 10), word(v + 14)
        out.toc = data[v + 26 : v + 26 + word(v + 18, 2) * word(v + 22, 2)]
        return True
    return False


def payload_of(data: bytes | None, found: Probe) -> bytes:
    """Ancillary bytes of the frames of sound, up to the length that the tag names."""
    said = found.tags.get("payload_bytes", "")
    if not data or not (said.isascii() and said.isdigit()) or len(said) > 18 or int(said) > len(data):
        return b""
    parts = [data[a + 4 + 2 * h.protected + h.side : a + h.size] for a, h in zip(found.offsets, found.heads, strict=True)]
    return b"".join(parts)[: int(said)]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text stored as an MPEG audio file."""
    schema = fields(("doc_id", id_type(docs)), ("n_bytes", "long"), ("media", "binary"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], names=schema.names
            )

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def probe_media(media: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and what the column `media` holds: payload figures, exact duration, seek offsets, checks, tags."""
    own = [(f.name, f.dataType) for f in media.select(*keep).schema]
    schema = fields(
        *own, ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"),
        ("frames", "long"), ("samples", "long"), ("sample_rate", "int"), ("seconds", "double"), ("crc_bad", "long"), ("skipped_bytes", "long"), ("seek_offsets", "array<long>"), ("tags", "map<string,string>"),
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = []
            for data in part.column(len(own)).to_pylist():
                p = probe(data)
                payload = payload_of(data, p)
                seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in p.offsets))
                feature = (
                    f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[p.heads[0].version] if p.heads else '-'}-layer{p.heads[0].layer if p.heads else '-'};rate={p.rate};"
                    f"frames={p.frames};samples={p.samples};kbps={p.kbps_min}-{p.kbps_max};crc={p.crc_checked - p.crc_bad}/{p.crc_checked};"
                    f"skipped={p.skipped};table={p.table or '-'}:{p.table_frames}:{p.table_bytes};seek={seek:08x}"
                )
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature,
                     p.frames, p.samples, p.rate, p.samples / p.rate if p.rate else 0.0, p.crc_bad, p.skipped, p.offsets, list(p.tags.items()))
                )
            i64, s, i32 = pa.int64(), pa.string(), pa.int32()
            kinds = (i64, s, i64, i64, s, s, i64, i64, i32, pa.float64(), i64, i64, pa.list_(i64), pa.map_(s, s))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *columns], names=schema.names)

    return map_arrow(media.select(*keep, "media"), run, schema)
