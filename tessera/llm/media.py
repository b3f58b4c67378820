"""Media columns: magic bytes found by Aho-Corasick, confirmed by format validators, embedded media carved out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, lean

#: (bytes, format, offset of the bytes in the format): fixed values of the formats themselves.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"BM", "bmp", 0),
    (b"RIFF", "riff", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
    (b"ftyp", "mp4", 4),
    (b"%PDF-", "pdf", 0),
    (b"PK\x03\x04", "zip", 0),
    (b"\x1f\x8b\x08", "gzip", 0),
)
RATE, PAD, UNIT = 8000, 32, 192


@dataclass(frozen=True)
class Found:
    offset: int
    length: int
    kind: str


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 characters, so that one character is one byte."""
    a = ahocorasick.Automaton()
    for magic, kind, at in MAGIC:
        key = magic.decode("latin-1")
        a.add_word(key, (*a.get(key, ()), (len(magic) - 1 + at, kind)))
    a.make_automaton()
    return a


def _png(b: memoryview, i: int) -> int:
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or first != (name == b"IHDR") or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return 0
        at, first = at + 12 + n, False
        if name == b"IEND":
            return at - i
    return 0


def _gif(b: memoryview, i: int) -> int:
    if i + 13 > len(b):
        return 0
    at = i + 13 + (3 << ((b[i + 10] & 7) + 1) if b[i + 10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x2C and at + 10 <= len(b):
            at += 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0)
        elif b[at] == 0x21:
            at += 2
        else:
            return 0
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return 0


def _jpeg(b: memoryview, i: int) -> int:
    at, scan = i + 2, False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return 0
        mark = b[at + 1]
        if not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD9:
            return 0
        at += 2 + struct.unpack_from(">H", b, at + 2)[0]
        if mark == 0xDA:
            scan = True
            while (at := b.obj.find(b"\xff", at)) >= 0 and at + 1 < len(b) and (b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7):
                at += 2
            if at < 0 or at + 1 >= len(b):
                return 0
            if b[at + 1] == 0xD9:
                return at + 2 - i
    return 0 if scan or at > len(b) else 0


def _bmp(b: memoryview, i: int) -> int:
    if i + 30 > len(b):
        return 0
    size, _, start, header = struct.unpack_from("<IIII", b, i + 2)
    planes, bits = struct.unpack_from("<HH", b, i + 26)
    return size if header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 54 <= start <= size <= len(b) - i else 0


def _riff(b: memoryview, i: int) -> tuple[int, str]:
    if i + 12 > len(b):
        return 0, ""
    size, form = struct.unpack_from("<I4s", b, i + 4)
    kind = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form, "")
    end = i + 8 + size
    if not kind or end > len(b):
        return 0, ""
    at, names = i + 12, []
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, at)
        names.append(name)
        at += 8 + n + (n & 1)
    good = at in (end, end + 1) and (kind != "wav" or names[:1] == [b"fmt "] and b"data" in names)
    return (8 + size, kind) if good else (0, "")


def _flac(b: memoryview, i: int) -> int:
    at = i + 4
    while at + 4 <= len(b):
        last, kind, n = b[at] >> 7, b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big")
        if at == i + 4 and (kind, n) != (0, 34):
            return 0
        at += 4 + n
        if last:
            return len(b) - i if at <= len(b) else 0
    return 0


def _ogg(b: memoryview, i: int) -> int:
    at = i
    while at + 27 <= len(b) and bytes(b[at : at + 4]) == b"OggS" and b[at + 4] == 0:
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            return 0
        at = end
    return at - i


def _mp4(b: memoryview, i: int) -> int:
    at = i
    while 0 <= at and at + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, at)
        if n < 8 or at + n > len(b) or not all(32 <= x < 127 for x in name):
            break
        at += n
    return max(0, at - i)


def _pdf(b: memoryview, i: int) -> int:
    end = b.obj.find(b"%%EOF", i)
    return end + 5 - i if end > i and bytes(b[i + 5 : i + 6]).isdigit() else 0


def _zip(b: memoryview, i: int) -> int:
    end = b.obj.find(b"PK\x05\x06", i)
    if end < 0 or end + 22 > len(b):
        return 0
    size, at = struct.unpack_from("<II", b, end + 12)
    return end + 22 + struct.unpack_from("<H", b, end + 20)[0] - i if at + size == end - i else 0


def _gzip(b: memoryview, i: int) -> int:
    d, rest = zlib.decompressobj(31), b[i:]
    try:
        while not d.eof:  # a part at a time, whatever it unpacks to
            out = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            if not out and not len(rest):
                break
    except zlib.error:
        return 0
    return len(b) - i - len(d.unused_data) if d.eof else 0


CHECK = {"png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "pdf": _pdf, "zip": _zip, "gzip": _gzip}


def sniff(data: bytes, machine: ahocorasick.Automaton) -> list[Found]:
    """Confirmed media in order of offset; a medium inside another one is carved as well."""
    view, out, seen = memoryview(data), [], set()
    for end, tags in machine.iter(data.decode("latin-1")):
        for back, kind in tags:
            at = end - back
            if at < 0 or (at, kind) in seen:
                continue
            seen.add((at, kind))
            n, name = _riff(view, at) if kind == "riff" else (CHECK[kind](view, at), kind)
            if n:
                out.append(Found(at, n, name))
    return sorted(out, key=lambda f: (f.offset, -f.length))


def sniff_media(rows: DataFrame, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """id, declared, detected (format at offset 0, else null), corrected (detected, else declared), embedded media.

    `embedded` lists (kind, offset, length, sha256, bytes) of media confirmed past offset 0. Null and empty bytes:
    nothing detected, empty list. Repeated rows are returned each; other columns are not read.
    """
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = automaton()
        for batch in batches:
            for part, data, off in chunks(batch, "media"):
                raw = data.tobytes()
                detected, inner = [], []
                for i in range(len(off) - 1):
                    one = raw[off[i] : off[i + 1]]
                    found = sniff(one, machine)
                    detected.append(next((f.kind for f in found if f.offset == 0), None))
                    inner.append([{"kind": f.kind, "offset": f.offset, "length": f.length, "sha256": hashlib.sha256(piece := one[f.offset : f.offset + f.length]).hexdigest(), "bytes": piece} for f in found if f.offset])
                said = part.column("declared").to_pylist()
                carved = pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("bytes", pa.binary())])
                yield pa.record_batch({"id": part.column("id"), "declared": pa.array(said, pa.string()), "detected": pa.array(detected, pa.string()), "corrected": pa.array([a or b for a, b in zip(detected, said, strict=True)], pa.string()), "embedded": pa.array(inner, pa.list_(carved))})

    return rows.select(F.col(id_col).alias("id"), F.col(bytes_col).cast("binary").alias("media"), declared.alias("declared")).mapInArrow(lean(run), f"id {kind}, declared string, detected string, corrected string, embedded array<struct<kind:string,offset:long,length:long,sha256:string,bytes:binary>>"
    )


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM, one sample a byte."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def wav_samples(data: bytes) -> bytes:
    """The data chunk, found by walking the chunks of a confirmed file."""
    at = 12
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("a confirmed file has no data chunk")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as a WAV file, sniffed, read back and described; null is an empty text.

    The feature names the confirmed format, its samples, their mean and spread, and the media carved from inside.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = automaton()
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                raw = data.tobytes()
                rows = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                for i in range(len(off) - 1):
                    text = raw[off[i] : off[i + 1]]
                    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
                    stored = wav(text + bytes([PAD]) * (size - len(text)))
                    found = sniff(stored, machine)
                    whole = next((f for f in found if f.offset == 0), None)
                    if whole is None or whole.kind != "wav" or whole.length != len(stored):
                        raise ValueError("a stored file was not recognised")
                    back = wav_samples(stored)
                    level = np.frombuffer(back, np.uint8)
                    inner = [f for f in found if f.offset]
                    rows["n_bytes"].append(len(text))
                    rows["payload_bytes"].append(len(back))
                    rows["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                    rows["tail_crc32"].append(zlib.crc32(back[-16:]))
                    rows["media_bytes"].append(len(stored))
                    rows["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                    rows["feature"].append(f"wav:{RATE}:1:8:{len(back)}:{level.mean():.4f}:{level.std():.4f}:{len(inner)}:{'+'.join(sorted({f.kind for f in inner}))}")
                yield pa.record_batch({"id": part.column("id"), **{k: pa.array(v) for k, v in rows.items()}})

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.withColumnRenamed("id", id_col)
