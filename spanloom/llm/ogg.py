"""Media columns: Ogg pages with 8-bit samples.

``store`` writes the bytes of a text, padded with zero bytes to a positive multiple of 64, as
8-bit mono samples in one logical stream of an Ogg file; a second logical stream, interleaved
with it, holds index marks. ``read`` verifies page checksums, reassembles packets from lacing
values (also across pages), demultiplexes the logical streams by serial number and derives
timestamps from granule positions; bytes that are damaged or missing are reported, not used.
``feature`` measures the samples that were read: loudness, zero crossings, changes, lags and a
histogram of all, and loudness and crossings up to each time that a granule position gives.

Serial numbers come from the content, so equal texts give equal files. Defined cases: a null
or empty text is stored as 64 zero samples; repeated rows give equal files; an empty table
gives an empty table; other columns are ignored; a null media value reads as no streams.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, pick, spread

UNIT = 64
RATE = 8000
#: Samples of a packet: not a multiple of 255, so its last lacing value is below 255.
PACKET = 16_000
MARK_EVERY = 8
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSE = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_PCM, _MARK = b"\x80pcm8", b"\x80mark"


def checksum(page: bytes) -> int:
    """The Ogg CRC (most significant bit first, no inversion), by zlib's reflected one."""
    x = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSE), "big")


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


@dataclass
class _Writer:
    """One logical stream: lays packets into pages of up to 255 segments."""

    serial: int
    out: list[bytes]
    sequence: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    continued: bool = False
    granule: int = -1

    def packet(self, data: bytes, granule: int) -> None:
        full, rest = divmod(len(data), 255)
        lacing = b"\xff" * full + bytes([rest])
        at = done = 0
        while at < len(lacing):
            take = min(255 - len(self.lacing), len(lacing) - at)
            end = min(len(data), done + 255 * take) if at + take < len(lacing) else len(data)
            self.lacing += lacing[at : at + take]
            self.body.append(data[done:end])
            at, done = at + take, end
            if at == len(lacing):
                self.granule = granule
            if len(self.lacing) == 255:
                self.page(goes_on=at < len(lacing))

    def page(self, goes_on: bool = False, last: bool = False) -> None:
        flags = (1 if self.continued else 0) | (2 if not self.sequence else 0) | (4 if last else 0)
        head = _HEAD.pack(b"OggS", 0, flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + bytes(self.lacing)
        page = head + b"".join(self.body)
        crc = checksum(page)
        self.out.append(page[:22] + crc.to_bytes(4, "little") + page[26:])
        self.sequence += 1
        self.lacing, self.body, self.continued, self.granule = bytearray(), [], goes_on, -1


def store(payload: bytes) -> bytes:
    """The Ogg file of a padded payload: stream headers, samples, and a mark every few packets."""
    key = hashlib.sha256(payload).digest()
    out: list[bytes] = []
    pcm = _Writer(int.from_bytes(key[:4], "little"), out)
    mark = _Writer(int.from_bytes(key[:4], "little") ^ 0x5A5A5A5A, out)
    pcm.packet(_PCM + struct.pack("<IBBQ", RATE, 1, 8, len(payload)), 0)
    pcm.page()
    mark.packet(_MARK + struct.pack("<II", RATE, MARK_EVERY), 0)
    mark.page()
    crc = 0
    for k, at in enumerate(range(0, len(payload), PACKET)):
        part = payload[at : at + PACKET]
        crc = zlib.crc32(part, crc)
        pcm.packet(part, at + len(part))
        if k % MARK_EVERY == MARK_EVERY - 1:
            mark.packet(struct.pack("<QI", at + len(part), crc), at + len(part))
            mark.page()
    pcm.page(last=True)
    mark.packet(struct.pack("<QI", len(payload), crc), len(payload))
    mark.page(last=True)
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[bool, int, int, int, int, bytes, int, int]]:
    """(checksum holds, flags, granule, serial, sequence, lacing, body start, body end) of each
    page; after damage the scan goes on at the next capture pattern."""
    at = 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            return
        _, version, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > len(data):
            at += 4
            continue
        whole = data[at:end]
        good = checksum(whole[:22] + bytes(4) + whole[26:]) == crc
        yield good, flags, granule, serial, sequence, lacing, start, end
        at = end if good else at + 4


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (packets complete so far, granule position) after each page that completes one
    times: list[tuple[int, int]] = field(default_factory=list)
    n_pages: int = 0
    bad_pages: int = 0
    gaps: int = 0
    ended: bool = False
    _part: list[bytes] = field(default_factory=list)
    _open: bool = False
    _next: int = 0


def read(data: bytes | None) -> dict[int, Stream]:
    """Logical streams by serial number, in the order in which they begin."""
    streams: dict[int, Stream] = {}
    for good, flags, granule, serial, sequence, lacing, start, _ in pages(data or b""):
        if not good:
            if serial in streams:
                streams[serial].bad_pages += 1
            continue
        s = streams.setdefault(serial, Stream(serial))
        s.n_pages += 1
        lost = sequence != s._next
        s.gaps += lost
        s._next = sequence + 1
        if lost or not flags & 1:
            s._part, s._open = [], False
        skip = bool(flags & 1) and not s._open  # the rest of a packet whose start is lost
        at = begin = start
        for value in lacing:
            at += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    s.packets.append(b"".join([*s._part, data[begin:at]]) if s._part else data[begin:at])
                s._part, s._open, begin = [], False, at
        if lacing and lacing[-1] == 255 and not skip:
            s._part.append(data[begin:at])
            s._open = True
        if granule >= 0:
            s.times.append((len(s.packets), granule))
        s.ended |= bool(flags & 4)
    return streams


def samples(streams: dict[int, Stream]) -> bytes:
    """What the sample streams hold, in order."""
    return b"".join(p for s in streams.values() if s.packets and s.packets[0].startswith(_PCM) for p in s.packets[1:])


def _rate(s: Stream) -> int:
    head = s.packets[0] if s.packets else b""
    own = len(head) >= len(_PCM) + 4 and head[: len(_PCM)] in (_PCM, _MARK)
    return (struct.unpack_from("<I", head, len(_PCM))[0] if own else 0) or RATE


#: Sample distances whose products are summed, and bins of the histogram.
LAGS, BINS = (1, 2, 3), 16


def _measured(x: np.ndarray) -> str:
    """Loudness (root mean square, in thousandths) and zero crossings of centred samples."""
    if not x.size:
        return "0/0"
    return f"{math.isqrt(int((x * x).sum()) * 1_000_000 // x.size)}/{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def sample_features(payload: bytes, times: list[tuple[int, int]], rate: int = RATE) -> str:
    """What 8-bit samples sound like: peak, loudness and zero crossings, the sum of changes, sums
    of products at LAGS, the histogram, and at each time (milliseconds) loudness and crossings
    since the one before. times: (samples, granule position) of the pages, rising."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    whole = f"peak={int(np.abs(x).max(initial=0))},loud={_measured(x)},change={int(np.abs(np.diff(x)).sum())}"
    lags = ".".join(str(int((x[k:] * x[:-k]).sum())) for k in LAGS)
    bins = ".".join(map(str, np.bincount((x + 128) * BINS // 256, minlength=BINS).tolist()))
    windows, at = [], 0
    for samples_, granule in times:
        windows.append(f"{granule * 1000 // rate}:{_measured(x[at:samples_])}")
        at = samples_
    return f"{whole},lags={lags},bins={bins},windows={'|'.join(windows)}"


def feature(streams: dict[int, Stream]) -> str:
    """Faults and duration of each stream, and the features of the samples of a sample stream."""
    said = []
    for s in streams.values():
        head = s.packets[0] if s.packets else b""
        kind = "pcm8" if head.startswith(_PCM) else "mark" if head.startswith(_MARK) else "other"
        last = s.times[-1][1] if s.times else 0
        line = f"{kind}:bad={s.bad_pages},gaps={s.gaps},end={int(s.ended)},ms={last * 1000 // _rate(s)}"
        if kind == "pcm8":
            ends = np.cumsum([0] + [len(p) for p in s.packets[1:]]).tolist()
            times = [(ends[packets - 1], granule) for packets, granule in s.times if packets > 1]
            line += "," + sample_features(b"".join(s.packets[1:]), times, _rate(s))
        said.append(line)
    return ";".join(said)


def _described(data: bytes | None) -> tuple:
    data = data or b""
    streams = read(data)
    payload = samples(streams)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(streams)


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the unpadded text) and the media column."""

    def run(part: pa.RecordBatch) -> dict:
        payloads = [(x or "").encode() for x in part.column(1).to_pylist()]
        return {"doc_id": part.column(0).cast(pa.int64()), "n_bytes": pa.array(map(len, payloads), pa.int64()), "media": pa.array([store(padded(p)) for p in payloads], pa.binary())}

    return map_slices(spread(pick(df, doc_id=id_col, text=text_col)), "doc_id long, n_bytes long, media binary", run)


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet: doc_id, serial, packet (its number in the stream), data, and
    end_ms, the time of the first granule position at or after the packet's end (else null)."""
    schema = "doc_id long, serial long, packet long, data binary, end_ms long"

    def run(part: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for s in read(media).values():
                rate, page = _rate(s), 0
                for k, data in enumerate(s.packets):
                    while page < len(s.times) and s.times[page][0] <= k:
                        page += 1
                    rows.append((doc_id, s.serial, k, data, s.times[page][1] * 1000 // rate if page < len(s.times) else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return {f.split()[0]: pa.array(c, k) for f, c, k in zip(schema.split(", "), columns, kinds, strict=True)}

    return map_slices(pick(df, doc_id=id_col, media=media_col), schema, run)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text and read the stored bytes back in the same task, a row at a time, so
    that the media of one row only is held; digests and features as SCHEMA names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload = (text.as_py() or "").encode()
                rows.append((doc_id, len(payload), *_described(store(padded(payload)))))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return spread(pick(df, doc_id=id_col, text=text_col)).mapInArrow(run, SCHEMA)
