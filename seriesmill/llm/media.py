"""Media columns: MPEG audio frames.

Reading resynchronises on frame headers, parses ID3v2 and ID3v1 tags and the tables of
variable-bitrate streams (Xing, Info, VBRI), verifies frame checksums, and gives exact
durations and the byte offsets of frames.

Writing stores a payload of bytes losslessly: MPEG-1 layer III frames of 80 kbit/s
mono at 48 kHz that decode to silence (all side information is zero), each with a
checksum over its header and side information, and 192 payload bytes as ancillary data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the format: kbit/s by bitrate index 1..14, and Hz.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)

PAYLOAD, UNIT = 192, 240
_HEADER = bytes([0xFF, 0xFA, 0x64, 0xC0])  # MPEG-1 layer III with checksum, 80 kbit/s, 48 kHz, mono
_SIDE = 17


def _crc_table() -> list[int]:
    table = []
    for x in range(256):
        x <<= 8
        for _ in range(8):
            x = (x << 1) ^ (0x8005 if x & 0x8000 else 0)
        table.append(x & 0xFFFF)
    return table


_CRC = _crc_table()


def frame_crc(data: bytes, bits: int | None = None) -> int:
    """The 16-bit checksum of MPEG audio (polynomial 0x8005, all ones at the start) over
    the first ``bits`` of ``data``, or all."""
    bits = 8 * len(data) if bits is None else bits
    crc = 0xFFFF
    for b in data[: bits // 8]:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ b]
    for k in range(bits % 8):
        bit = data[bits // 8] >> 7 - k & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


# Fixed values of the format: bits of the allocation of each subband of layer II, as runs
# of (subbands, bits), by the table that bitrate and rate choose.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    length: int
    samples: int
    shared_from: int = 32  # the first subband that both channels share (joint stereo of layers I and II)

    @property
    def allocations(self) -> list[int]:
        """Bits of the allocation of each subband of layers I and II."""
        if self.layer == 1:
            return [4] * 32
        if self.version != 1:
            table = "lsf"
        else:
            each = self.kbps // self.channels
            table = ("d" if self.rate == 32000 else "c") if each < 56 else "a" if each <= 80 or self.rate == 48000 else "b"
        return [bits for count, bits in ALLOCATIONS[table] for _ in range(count)]

    @property
    def side_bytes(self) -> int:
        if self.layer != 3:
            return 0
        return {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[1 if self.version == 1 else 2, self.channels]


def parse_header(b: bytes, at: int = 0) -> Header | None:
    """The frame header at ``at``, or None where its fields aren't valid."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    one, two, three = b[at + 1 : at + 4]
    version = {0: 25, 2: 2, 3: 1}.get(one >> 3 & 3)
    layer = 4 - (one >> 1 & 3)
    index, rate = two >> 4, two >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or three & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 1 else 2, layer][index - 1]
    hertz = RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    pad = two >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (kbps * 12000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    joint = three >> 6 == 1 and layer != 3
    return Header(version, layer, not one & 1, kbps, hertz, 1 if three >> 6 == 3 else 2, length, samples, 4 * (three >> 4 & 3) + 4 if joint else 32)


def protected_bits(b: bytes, at: int, h: Header) -> int | None:
    """How many bits behind the checksum of the frame at ``at`` it covers, besides the
    header's last 16; None if the frame is too short for them.

    Layer III: the side information. Layer I: the allocation. Layer II: the allocation and
    two bits of scale factor selection for each subband and channel that has any.
    """
    room = 8 * (min(at + h.length, len(b)) - at - 6)
    if h.layer == 3:
        bits = 8 * h.side_bytes
        return bits if bits <= room else None
    allocations = h.allocations
    shared = min(h.shared_from, len(allocations)) if h.channels == 2 else len(allocations)
    bits = sum(allocations[:shared]) * h.channels + sum(allocations[shared:])
    if bits > room or bits <= 0:
        return None
    if h.layer == 1:
        return bits
    value = int.from_bytes(b[at + 6 : at + 6 + -(-bits // 8)], "big") >> -bits % 8
    left, chosen = bits, 0
    for k, width in enumerate(allocations):
        for _ in range(h.channels if k < shared else 1):
            left -= width
            used = value >> left & (1 << width) - 1
            chosen += (1 if k < shared else h.channels) * (used != 0)
    bits += 2 * chosen
    return bits if bits <= room else None


@dataclass
class Audio:
    """What a stream of frames says. ``offsets`` has the byte place of each frame."""

    headers: Header | None = None
    frames: int = 0
    samples: int = 0
    rate: int = 0
    bad_checksums: int = 0
    checked: int = 0
    skipped: int = 0
    offsets: list[int] = field(default_factory=list)
    table: dict | None = None
    tags: dict[str, str] = field(default_factory=dict)
    payload_ok: bool | None = None  # as the tag of a stored payload says, where there is one

    @property
    def duration(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def parse_tags(b: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, and the [start, end) of the audio between an ID3v2 and an ID3v1 tag."""
    tags, start, end = {}, 0, len(b)
    if b[:3] == b"ID3" and len(b) >= 10:
        size = _syncsafe(b[6:10])
        start, at, stop = 10 + size + (10 if b[5] & 0x10 else 0), 10, min(10 + size, len(b))
        major = b[3]
        if b[5] & 0x40 and at + 4 <= stop:
            at += _syncsafe(b[at : at + 4]) if major >= 4 else struct.unpack(">I", b[at : at + 4])[0] + 4
        while at + 10 <= stop and b[at] and major >= 3:
            name = b[at : at + 4].decode("latin-1")
            n = _syncsafe(b[at + 4 : at + 8]) if major >= 4 else struct.unpack(">I", b[at + 4 : at + 8])[0]
            body = b[at + 10 : min(at + 10 + n, stop)]
            if name[0] == "T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                tags[name] = body[1:].decode(code, "replace").strip("\0")
            at += 10 + n
        start = min(start, len(b))
    if end - start >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, z in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TDRC", 93, 97)):
            if text := b[end + a : end + z].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, text)
    return tags, start, end


def _bitrate_table(b: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at ``at``, or what of it the frame holds."""
    frame = b[at : at + h.length]
    xing = 4 + 2 * h.protected + h.side_bytes
    if h.layer == 3 and frame[xing : xing + 4] in (b"Xing", b"Info") and xing + 8 <= len(frame):
        flags = struct.unpack(">I", frame[xing + 4 : xing + 8])[0]
        out, p = {"kind": frame[xing : xing + 4].decode()}, xing + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(frame):
                out[name] = struct.unpack(">I", frame[p : p + 4])[0]
                p += 4
        if flags & 4 and p + 100 <= len(frame):
            out["toc"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        body = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(body[k : k + width], "big") * scale for k in range(0, len(body) - width + 1, max(width, 1))] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": per}
    return None


def parse_audio(b: bytes, on_frame=None) -> Audio:
    """Walks the frames. Where no frame continues, it looks for the next header that
    another header of the same kind (or the end) follows, and counts the bytes between.
    A protected frame that is too short for what its checksum covers counts as bad.
    ``on_frame(start, length, header)`` sees each frame of sound."""
    out = Audio()
    out.tags, at, end = parse_tags(b)
    locked = False
    while at + 4 <= end:
        h = parse_header(b, at)
        fits = h is not None and h.length > 4 and at + h.length <= end
        if fits and not locked and at + h.length < end:
            n = parse_header(b, at + h.length)
            fits = n is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)
        if not fits:
            locked = False
            nxt = b.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        locked = True
        if h.protected:
            out.checked += 1
            bits = protected_bits(b, at, h)
            told = b[at + 4 : at + 6]
            covered = b[at + 2 : at + 4] + b[at + 6 : at + 6 + -(-(bits or 0) // 8)]
            out.bad_checksums += bits is None or told != frame_crc(covered, 16 + bits).to_bytes(2, "big")
        table = None if out.frames or out.table else _bitrate_table(b, at, h)
        if table:
            out.table = table
        else:
            out.headers = out.headers or h
            out.rate = h.rate
            out.frames += 1
            out.samples += h.samples
            out.offsets.append(at)
            if on_frame:
                on_frame(at, h.length, h)
        at += h.length
    out.skipped += max(0, end - at)
    return out


# --- storing payloads -------------------------------------------------------------------


def _silent(kind: int = 0) -> bytes:
    side = bytes(_SIDE)
    return _HEADER + struct.pack(">H", frame_crc(_HEADER[2:] + side)) + side


_FRONT = _silent()


def to_audio(payload: bytes) -> bytes:
    """A stream whose frames hold ``payload`` (a multiple of 192 bytes): a tag with its
    length and checksum, a frame with the Info table, the frames, and an empty ID3v1 tag,
    without which a reader would take payload that spells TAG at its place for one."""
    frames = len(payload) // PAYLOAD
    text = f"{len(payload)} {zlib.crc32(payload):08x}".encode()
    body = b"TXXX" + len(b"\x03payload\0" + text).to_bytes(4, "big") + b"\0\0" + b"\x03payload\0" + text
    tag = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7 & 127, len(body) & 127]) + body
    toc = bytes(min(255, 256 * k // 100) for k in range(100))
    info = (_FRONT + b"Info" + struct.pack(">III", 7, frames, frames * UNIT) + toc).ljust(UNIT, b"\0")
    cells = np.zeros((frames, UNIT), np.uint8)
    cells[:, : len(_FRONT)] = np.frombuffer(_FRONT, np.uint8)
    cells[:, len(_FRONT) : len(_FRONT) + PAYLOAD] = np.frombuffer(payload, np.uint8).reshape(frames, PAYLOAD)
    return tag + info + cells.tobytes() + b"TAG".ljust(128, b"\0")


def from_audio(b: bytes) -> tuple[Audio, bytes]:
    """What ``parse_audio`` finds, and the payload of the frames, held against the length
    and checksum of the tag."""
    parts = []
    skip = len(_FRONT)
    audio = parse_audio(b, lambda at, n, h: parts.append(b[at + skip : at + skip + PAYLOAD]) if n == UNIT else None)
    payload = b"".join(parts)
    name, _, told = audio.tags.get("TXXX", "").partition("\0")
    if name == "payload":
        audio.payload_ok = told == f"{len(payload)} {zlib.crc32(payload):08x}"
    return audio, payload


def _store(batches):
    for pdf in batches:
        for k in range(0, len(pdf), 500):
            part = pdf.iloc[k : k + 500]
            media = []
            for text in part["text"]:
                raw = (text or "").encode()
                media.append((len(raw), to_audio(raw.ljust(max(PAYLOAD, -(-len(raw) // PAYLOAD) * PAYLOAD), b" "))))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [m[0] for m in media], "media": [m[1] for m in media]})


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``docs`` (doc_id, text) as a stream.

    The UTF-8 bytes of the text (null: empty) are filled up with spaces to a positive
    multiple of 192. Repeated rows and ids are stored each; equal texts make equal bytes.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_store, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frames long, seek array<long>"


def _describe(every: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, n_bytes, media in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"]):
                audio, payload = from_audio(media)
                h = audio.headers
                us = audio.samples * 1_000_000 // audio.rate if audio.rate else 0
                seek = audio.offsets[::every]
                feature = f"mpeg{h.version}.{h.layer} {h.kbps}k {h.rate}Hz ch{h.channels} frames={audio.frames} us={us} table={(audio.table or {}).get('kind')}:{(audio.table or {}).get('frames')} checked={audio.checked} bad={audio.bad_checksums} skipped={audio.skipped} payload_ok={audio.payload_ok} last={audio.offsets[-1]}" if h else "none"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, us, audio.frames, seek))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def describe_media(media: DataFrame, seek_every: int = 50) -> DataFrame:
    """Digests and features of stored streams (doc_id, n_bytes, media): the payload,
    exact duration in microseconds, number of frames, and the byte offset of every
    ``seek_every``-th frame."""
    return media.mapInPandas(_describe(seek_every), FEATURES)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Stores the texts as a table with a media column, reads the stored bytes and
    describes them, with the offset of every frame."""
    return describe_media(stored(store_media(docs), "media"), seek_every=1)
