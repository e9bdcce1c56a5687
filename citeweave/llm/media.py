"""Media columns: payloads stored as MPEG transport streams and read back.

``mux`` writes a payload as a single-program transport stream: a program association
table and a program map table, repeated before every random-access point, and one
elementary stream of private data, cut into access units of ``UNIT`` bytes, each in a
packetised elementary stream packet with a presentation time. The first transport
packet of a unit carries the program clock; that of every ``GOP``-th unit says that it
is a random-access point. A private descriptor in the map table holds the payload's
size, so a stream that lost its tail is noticed. ``demux`` trusts nothing else that
``mux`` knew: it finds the packet identifiers through the tables, checks their CRC and
every continuity counter, drops the duplicate that the format allows, reassembles the
elementary packets, and lists timestamps and random-access points. A stream without
tables, or with less or more payload than its tables say, is a ValueError.

Null text counts as empty. Equal payloads give equal streams. Rows are stored and read
each for itself: repeated rows repeat their results, null ids are kept, nothing is
ordered, very long texts are more packets. An empty table gives an empty one; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_slices

BLOCK = 576
PACKET = 188
#: Bytes of payload in an access unit, units between random-access points, 90 kHz ticks between units.
UNIT, GOP, TICKS = 4608, 8, 3003
PAT_PID, PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x0000, 0x0100, 0x0101, 1, 0x06, 0xBD


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) ^ _CRC[(c >> 24) ^ b]) & 0xFFFFFFFF
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter) + b"\0" + section).ljust(PACKET, b"\xff")


#: Tag of the private descriptor that holds the payload's size in eight bytes, and of the registration that goes before it.
_SIZE_TAG, _REGISTRATION = 0x80, b"\x05\x04cwpl"
#: Ticks by which the clock runs behind presentation.
DELAY = 9009


def _tables(size: int, counter: int) -> bytes:
    """Both tables as packets with this continuity counter."""
    described = _REGISTRATION + struct.pack(">BBQ", _SIZE_TAG, 8, size)
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000 | len(described)) + described)
    return _table_packet(PAT_PID, pat, counter) + _table_packet(PMT_PID, pmt, counter)


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 30 & 7) << 1, (pts >> 15 & 0x7FFF) << 1 | 1, (pts & 0x7FFF) << 1 | 1)


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | (b[1] << 8 | b[2]) >> 1 << 15 | (b[3] << 8 | b[4]) >> 1


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def _clock(ticks: int) -> bytes:
    """A program clock reference at a whole tick of 90 kHz."""
    return ((ticks % (1 << 33)) << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        point = k % GOP == 0
        if point:
            out.append(_tables(len(payload), k // GOP & 15))
        unit = payload[at : at + UNIT]
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _stamp(k * TICKS % (1 << 33)) + unit
        # what the adaptation field of the unit's first packet holds: flags and clock
        field = bytes([0x50 if point else 0x10]) + _clock(k * TICKS - DELAY)
        pos = 0
        while pos < len(pes):
            body = pes[pos : pos + 184 - (len(field) + 1 if field else 0)]
            spare = 184 - len(body)
            if field:
                adapt = bytes([spare - 1]) + field.ljust(spare - 1, b"\xff")
            else:
                adapt = b"" if not spare else b"\0" if spare == 1 else bytes([spare - 1, 0]) + b"\xff" * (spare - 2)
            out.append(struct.pack(">BHB", 0x47, (0x4000 if not pos else 0) | DATA_PID, (0x30 if adapt else 0x10) | counter) + adapt + body)
            counter, field = (counter + 1) & 15, b""
            pos += len(body)
    return b"".join(out)


class _Reader:
    """What a stream has shown so far."""

    def __init__(self) -> None:
        self.map_pid = self.data_pid = self.size = None
        self.seen: dict[int, tuple[int, bytes, bool]] = {}
        self.payload: list[bytes] = []
        self.length, self.pts, self.points = 0, [], []
        self.pending: list[bytes] = []
        self.random = False

    def repeats(self, pid: int, counter: int, body: bytes, breaks: bool) -> bool:
        """Check the continuity of a packet with payload; true of the one duplicate that may follow a packet."""
        if pid in self.seen and not breaks:
            last, before, doubled = self.seen[pid]
            if counter == last and body == before and not doubled:
                self.seen[pid] = last, before, True
                return True
            if counter != (last + 1) & 15:
                raise ValueError(f"continuity of packet identifier {pid} breaks")
        self.seen[pid] = counter, body, False
        return False

    def table(self, pid: int, body: bytes) -> None:
        section = body[1 + body[0] :]
        section = section[: 3 + (struct.unpack_from(">H", section, 1)[0] & 0xFFF)]
        if len(section) < 12 or crc32_mpeg(section):
            raise ValueError("bad table checksum")
        own = section[8:-4]
        if pid == PAT_PID and section[0] == 0:
            programs = [struct.unpack_from(">HH", own, i) for i in range(0, len(own) - 3, 4)]
            self.map_pid = next((p & 0x1FFF for number, p in programs if number), None)
        elif pid != PAT_PID and section[0] == 2:
            at = 4 + (struct.unpack_from(">H", own, 2)[0] & 0xFFF)
            while at + 5 <= len(own):
                kind, stream, info = struct.unpack_from(">BHH", own, at)
                if kind == STREAM_TYPE:
                    self.data_pid = stream & 0x1FFF
                    self.describe(own[at + 5 : at + 5 + (info & 0xFFF)])
                    break
                at += 5 + (info & 0xFFF)

    def describe(self, descriptors: bytes) -> None:
        at = 0
        while at + 2 <= len(descriptors):
            tag, n = descriptors[at], descriptors[at + 1]
            if tag == _SIZE_TAG and n == 8:
                self.size = struct.unpack_from(">Q", descriptors, at + 2)[0]
            at += 2 + n

    def close(self) -> None:
        """The elementary packet that is open ends."""
        if not self.pending:
            return
        pes = b"".join(self.pending)
        self.pending.clear()
        start, length, _, flags, head = struct.unpack_from(">IHBBB", pes)
        if start >> 8 != 1 or length != len(pes) - 6:
            raise ValueError("broken elementary packet")
        if self.random:
            self.points.append(self.length)
        self.pts.append(_read_stamp(pes[9:14]) if flags & 0x80 else -1)
        self.payload.append(pes[9 + head :])
        self.length += len(self.payload[-1])

    def packet(self, packet: bytes) -> None:
        sync, word, control = struct.unpack_from(">BHB", packet)
        if sync != 0x47:
            raise ValueError("no sync byte")
        pid, begins, skip, flags = word & 0x1FFF, word & 0x4000, 4, 0
        if control & 0x20:
            skip += 1 + packet[4]
            flags = packet[5] if packet[4] else 0
        if not control & 0x10:
            return
        if skip >= PACKET:
            raise ValueError("an adaptation field leaves no payload")
        body = packet[skip:]
        if self.repeats(pid, control & 15, body, bool(flags & 0x80)):
            return
        if pid == self.data_pid:
            if begins:
                self.close()
                self.random = bool(flags & 0x40)
            elif not self.pending:
                raise ValueError("an elementary packet lacks its beginning")
            self.pending.append(body)
        elif begins and pid in (PAT_PID, self.map_pid):
            self.table(pid, body)


def demux(stream: bytes) -> dict:
    """Read a transport stream: ``payload``, ``pts`` and ``random_access`` (byte offsets in the payload), ``packets``.

    Raises ValueError for a lost sync byte, missing or bad tables, a broken continuity
    counter, a broken elementary packet, and a payload that is not as long as the tables say.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    got = _Reader()
    try:
        for at in range(0, len(stream), PACKET):
            got.packet(stream[at : at + PACKET])
        got.close()
    except (struct.error, IndexError) as e:
        raise ValueError("a field ends early") from e
    if got.data_pid is None or got.size is None:
        raise ValueError("no program tables")
    if got.length != got.size:
        raise ValueError(f"{got.length} bytes of payload, not {got.size}")
    return {"payload": b"".join(got.payload), "pts": got.pts, "random_access": got.points, "packets": len(stream) // PACKET}


def _feature(got: dict) -> str:
    """Units, timestamps and random-access points in brief."""
    pts, points = got["pts"], got["random_access"]
    marks = zlib.crc32(struct.pack(f"<{len(pts)}Q{len(points)}Q", *pts, *points))
    return f"ts:packets={got['packets']};units={len(pts)};first_pts={pts[0]};last_pts={pts[-1]};random_access={len(points)};marks={marks:08x}"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        raw = [t.encode() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(pad(r)) for r in raw], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )


def store_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the transport stream ``media`` of every document."""
    return documents.select("doc_id", "text").mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            got = [demux(m) for m in part.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([g["payload"] for g in got], pa.binary()),
                    pa.array([g["pts"] for g in got], pa.list_(pa.int64())),
                    pa.array([g["random_access"] for g in got], pa.list_(pa.int64())),
                    pa.array([g["packets"] for g in got], pa.int64()),
                ],
                ["doc_id", "payload", "pts", "random_access", "packets"],
            )


def read_media(stored: DataFrame) -> DataFrame:
    """Payload, timestamps and random-access points of stored streams (columns doc_id, media)."""
    return stored.filter(F.col("media").isNotNull()).select("doc_id", "media").mapInArrow(
        _read_batches, "doc_id long, payload binary, pts array<long>, random_access array<long>, packets long"
    )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for part in _store_batches(batches):
        rows = []
        for n, media in zip(part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
            got = demux(media)
            payload = got["payload"]
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), _feature(got)))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])


def media_digest(documents: DataFrame) -> DataFrame:
    """Store every document, read the stored bytes back, and return digests of both.

    The stream stays inside the task: only digests leave it. Repeated rows give
    repeated results; an empty table gives an empty one.
    """
    return documents.select("doc_id", "text").mapInArrow(
        _digest_batches,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
