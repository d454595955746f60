import hashlib
import random
import struct
import zlib

import pytest

from seriesmill.llm import media

from .helpers import awkward, documents


def padded(text):
    raw = (text or "").encode()
    return raw, raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")


def test_round_trip_of_awkward_rows(spark):
    got = media.media_round_trip(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    texts = {}
    for i, t in awkward():
        texts[i] = t
    for r in got:
        raw, payload = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stream = media.to_audio(payload)
        assert r.media_bytes == len(stream) and r.media_sha256 == hashlib.sha256(stream).hexdigest()
        assert r.frames == len(payload) // 192 and r.duration_us == r.frames * 24000
        assert "bad=0 skipped=0" in r.feature
    assert media.media_round_trip(documents(spark, [])).collect() == []


def test_resynchronises_over_junk_and_counts_it():
    stream = media.to_audio(padded("abc" * 300)[1])
    tags, start, _ = media.parse_tags(stream)
    frames = stream[start + 240 :]
    junk = b"\xff\xfb\x00junk\xff\xe0"
    audio, payload = media.from_audio(junk + frames[:480] + b"\xff\xff noise" + frames[480:])
    assert audio.skipped == len(junk) + len(b"\xff\xff noise") and audio.frames == len(frames) // 240
    assert payload == padded("abc" * 300)[1]
    assert audio.offsets[0] == len(junk)


def test_broken_side_information_fails_its_checksum():
    stream = bytearray(media.to_audio(padded("abc" * 300)[1]))
    start = media.parse_tags(bytes(stream))[1]
    stream[start + 240 + 10] ^= 1
    audio, _ = media.from_audio(bytes(stream))
    assert audio.bad_checksums == 1 and audio.checked == audio.frames + 1


def test_headers_tags_and_tables():
    h = media.parse_header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.version, h.layer, h.protected, h.kbps, h.rate, h.channels, h.length, h.samples) == (1, 3, False, 128, 44100, 2, 417, 1152)
    two = media.parse_header(bytes([0xFF, 0xF3, 0x40, 0xC0]))
    assert (two.version, two.rate, two.samples, two.channels, two.length) == (2, 22050, 576, 1, 104)
    one = media.parse_header(bytes([0xFF, 0xFF, 0x14, 0xC0]))
    assert (one.layer, one.kbps, one.rate, one.samples, one.length) == (1, 32, 48000, 384, 32)
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x0c\x00", b"\xff\xe8\x90\x00", b"\xff\xf9\x90\x00", b"\x00\xfb\x90\x00", b"\xff"):
        assert media.parse_header(bad) is None
    old = b"TAG" + b"Title".ljust(30, b"\0") + b"Name".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + bytes(31)
    tags, start, end = media.parse_tags(b"x" * 10 + old)
    assert tags == {"TIT2": "Title", "TPE1": "Name", "TALB": "Album", "TDRC": "1999"} and (start, end) == (0, 10)
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1000, 7, 2, 1, 2, 3) + struct.pack(">HH", 5, 6)
    table = media._bitrate_table(frame, 0, h)
    assert table == {"kind": "VBRI", "frames": 7, "bytes": 1000, "toc": [5, 6], "frames_per_entry": 3}


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"\xff\xfb\x90\x64" * 3, bytes(500)])
def test_garbage_has_no_frames(data):
    audio, payload = media.from_audio(data)
    assert audio.frames == 0 and payload == b"" and audio.duration == 0


def test_payload_that_spells_a_tag_is_kept(spark):
    texts = ["x" * (192 * n + k) + "TAG" + "y" * 100 for n in (0, 2) for k in range(86, 93)]
    got = media.media_round_trip(documents(spark, list(enumerate(texts)))).collect()
    for r in got:
        payload = padded(texts[r.doc_id])[1]
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.frames == len(payload) // 192 and "bad=0 skipped=0" in r.feature
    assert len(got) == len(texts)


def test_query_walks_checks_the_payload_and_has_every_offset(spark):
    payload = padded("abc" * 300)[1]
    stream = bytearray(media.to_audio(payload))
    assert media.from_audio(bytes(stream))[0].payload_ok is True
    start = media.parse_tags(bytes(stream))[1]
    stream[start + 240 + 100] ^= 1
    audio, read = media.from_audio(bytes(stream))
    assert audio.payload_ok is False and read != payload and audio.bad_checksums == 0
    (row,) = media.media_round_trip(documents(spark, [(1, "word " * 4000)])).collect()
    assert len(row.seek) == row.frames > 50 and set(b - a for a, b in zip(row.seek, row.seek[1:])) == {240} and "payload_ok=True" in row.feature


def bits(value, width):
    return f"{value:0{width}b}"


def frame(header, body_bits):
    """A frame of zeros behind its checksum and the bits that this covers."""
    covered = bits(int.from_bytes(header[2:], "big"), 16) + body_bits
    crc = 0xFFFF
    for bit in covered:  # the division, bit by bit
        top = crc >> 15 ^ int(bit)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    packed = int(body_bits.ljust(-(-len(body_bits) // 8) * 8, "0"), 2).to_bytes(-(-len(body_bits) // 8), "big")
    return (header + crc.to_bytes(2, "big") + packed).ljust(media.parse_header(header).length, b"\0")


LAYER_1_STEREO = bytes([0xFF, 0xFE, 0x94, 0x00])  # 288 kbit/s, 48 kHz
LAYER_1_JOINT = bytes([0xFF, 0xFE, 0x94, 0x50])  # the first 8 subbands apart
LAYER_2_MONO = bytes([0xFF, 0xFC, 0x54, 0xC0])  # 80 kbit/s, 48 kHz: 27 subbands
LAYER_2_JOINT = bytes([0xFF, 0xFC, 0x90, 0x60])  # 160 kbit/s, 44.1 kHz: 27 subbands, 12 apart
LAYER_2_HALF = bytes([0xFF, 0xF4, 0x80, 0xC0])  # MPEG-2, 64 kbit/s, 22.05 kHz: 30 subbands


@pytest.mark.parametrize(
    "header, allocation, selected",
    [
        (LAYER_1_STEREO, [4] * 64, 0),
        (LAYER_1_JOINT, [4] * 16 + [4] * 24, 0),
        (LAYER_2_MONO, [4] * 11 + [3] * 12 + [2] * 4, 2),
        (LAYER_2_HALF, [4] * 4 + [3] * 7 + [2] * 19, 2),
        (LAYER_2_JOINT, [w for w in [4] * 11 + [3] for _ in range(2)] + [3] * 11 + [2] * 4, 4),
    ],
)
def test_checksums_of_layers_one_and_two(header, allocation, selected):
    used = [k % 3 == 1 for k in range(len(allocation))]
    body = "".join(bits(int(u), w) for u, w in zip(used, allocation))
    if header == LAYER_2_JOINT:  # two bits for each channel of a used subband; shared subbands have two channels
        body += "01" * (sum(used[:24]) + 2 * sum(used[24:]))
    elif selected:
        body += "10" * sum(used)
    one = frame(header, body)
    good = media.parse_audio(one * 3)
    assert (good.frames, good.checked, good.bad_checksums) == (3, 3, 0)
    assert media.protected_bits(one, 0, media.parse_header(one)) == len(body)
    broken = bytearray(one)
    broken[6] ^= 0x80
    assert media.parse_audio(one + bytes(broken) + one).bad_checksums == 1


def test_truncated_tables_and_damaged_streams_are_read_as_far_as_they_go():
    header = bytes([0xFF, 0xFB, 0x10, 0xC0])  # 32 kbit/s mono: 104 bytes
    h = media.parse_header(header)
    for kind in (b"Xing", b"Info"):
        whole = header + bytes(17) + kind + struct.pack(">III", 7, 5, 500) + bytes(range(100))
        assert media._bitrate_table(whole + bytes(50), 0, h)["frames"] == 5
        assert "toc" not in media._bitrate_table(whole + bytes(50), 0, h)  # the frame ends before it does
        for n in range(len(whole)):
            table = media._bitrate_table(whole[:n], 0, h)
            assert (table is None) == (n < 29) and (table is None or ("frames" in table) == (n >= 33))
    short = bytes([0xFF, 0xF3, 0x14, 0xC0])  # MPEG-2, 8 kbit/s, 24 kHz: 24 bytes, 9 of side information
    tiny = (short + bytes(9) + b"Xing" + struct.pack(">I", 7)).ljust(24, b"\0")
    audio = media.parse_audio(tiny + (short + bytes(20)) * 3)
    assert audio.table == {"kind": "Xing"} and audio.frames == 3
    vbri = header + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 1000, 7, 60, 1, 2, 3) + bytes(120)
    for n in range(len(vbri)):
        media._bitrate_table(vbri[:n], 0, h)
    rng = random.Random(4)
    stream = media.to_audio(padded("abc" * 300)[1])
    for _ in range(300):
        part = bytearray(stream[: rng.randrange(len(stream))])
        for _ in range(rng.randrange(20)):
            if part:
                part[rng.randrange(len(part))] = rng.randrange(256)
        audio, _ = media.from_audio(bytes(part))
        assert audio.frames == len(audio.offsets) and audio.bad_checksums <= audio.checked
