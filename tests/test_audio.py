"""Uploads: renamed, truncated and large files, by their bytes."""

import struct

import pytest

from lorikeet.sources.audio import checked_audio, contained

WAV = b"RIFF" + struct.pack("<I", 36 + 800) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 800) + bytes(800)
box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
M4A = box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", bytes(100)) + box(b"mdat", bytes(9000))
page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([-(-len(body) // 255)]) + bytes([255] * (len(body) // 255) + [len(body) % 255] * (len(body) % 255 > 0)) + body
OGG = page(2, bytes(30)) + page(0, bytes(600)) + page(4, bytes(300))
WEBM = b"\x1a\x45\xdf\xa3" + b"\x84webm" + b"\x18\x53\x80\x67" + b"\x08" + (5000).to_bytes(4, "big") + bytes(5000)
MP3 = b"ID3\x03\0\0\0\0\0\x0a" + bytes(10) + b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">III", 3, 10, 2000) + bytes(1948)
FLAC = b"fLaC\0" + (34).to_bytes(3, "big") + bytes(400)


@pytest.mark.parametrize(("raw", "kind"), [(WAV, "wav"), (M4A, "mp4"), (OGG, "ogg"), (WEBM, "webm"), (MP3, "mpeg"), (FLAC, "flac")])
def test_containers(raw, kind):
    ends = lambda b: (b[:4096], b[-65536:], len(b))
    assert contained(*ends(raw)) == (f"audio/{kind}", True)
    if kind != "flac":
        assert contained(*ends(raw[:-1])) == (f"audio/{kind}", False)
    assert contained(*ends(raw[: len(raw) // 2]))[1] == (kind == "flac")
    for n in range(40):  # cut anywhere in the header
        contained(*ends(raw[:n]))


def test_unknown_and_unstated_lengths():
    assert contained(b"", b"", 0) == (None, True)
    assert contained(b"\x89PNG\r\n\x1a\n", b"", 8) == (None, True)
    live = b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + bytes(9)
    assert contained(live, live, len(live)) == ("audio/webm", True)
    open_ = box(b"ftyp", b"M4A \0\0\0\0") + b"\0\0\0\0mdat" + bytes(50)
    assert contained(open_, open_, len(open_)) == ("audio/mp4", True)


def test_uploads(spark, tmp_path):
    files = {
        "a.wav": WAV, "b.M4A": M4A, "c.ogg": OGG, "deep/d.webm": WEBM, "e.mp3": MP3, "f.flac": FLAC, "renamed.mp3": WAV, "renamed.wav": OGG,
        "picture.wav": b"\x89PNG" + bytes(100), "cut.wav": WAV[:500], "cut.ogg": OGG[:-200], "cut.m4a": M4A[:4000], "empty.wav": b"",
        "notes.txt": b"RIFF", "large.wav": WAV + bytes(20_000),
    }
    (tmp_path / "deep").mkdir()
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in checked_audio(spark, str(tmp_path), 15_000).collect()}
    assert got == {
        "a.wav": "ok", "b.M4A": "ok", "c.ogg": "ok", "d.webm": "ok", "e.mp3": "ok", "f.flac": "ok", "renamed.mp3": "renamed",
        "renamed.wav": "renamed", "picture.wav": "not_audio", "cut.wav": "truncated", "cut.ogg": "truncated", "cut.m4a": "truncated",
        "notes.txt": "not_audio", "large.wav": "too_large",  # Spark lists no empty files
    }
