"""Signature sniffing of media columns: magic bytes, structure checks, carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a
blob. A validator per format then walks its structure (chunks, blocks, check sums,
lengths) and tells where the medium ends; a signature whose structure does not hold
is no medium. The medium at offset 0 gives the blob's type, whatever was declared;
media further in are embedded and can be carved out.

``store`` keeps payloads losslessly as 8-bit mono samples in WAVE files: the UTF-8
bytes of the text, padded with zero bytes to a positive multiple of 64. ``features``
reads stored media back through the sniffer.

Special rows: a null text counts as empty (64 zero bytes); rows with a null doc_id and
repeated rows are kept; extra columns are ignored; blobs without a valid medium at
offset 0 get the type application/octet-stream. A WAVE file holds less than 4 GiB,
which also bounds a text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import out_batches, rows_of, whole_text
from lamella.plans.spool import spool

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


def wave(payload: bytes) -> bytes:
    """8-bit mono samples as a WAVE file."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wave_chunks(blob: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Start and length of each chunk of a WAVE file, and under b"" its whole extent."""
    if len(blob) < at + 12 or blob[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", blob, at + 4)[0]
    chunks, here = {b"": (at, end - at)}, at + 12
    if end > len(blob):
        return None
    while here + 8 <= end:
        name, size = struct.unpack_from("<4sI", blob, here)
        if here + 8 + size > end:
            return None
        chunks.setdefault(name, (here + 8, size))
        here += 8 + size + size % 2
    return chunks if here >= end and b"fmt " in chunks and b"data" in chunks else None


def wave_end(blob: bytes, at: int) -> int | None:
    chunks = wave_chunks(blob, at)
    return chunks and sum(chunks[b""])


def png_end(blob: bytes, at: int) -> int | None:
    here, first = at + 8, True
    while here + 12 <= len(blob):
        size, name = struct.unpack_from(">I4s", blob, here)
        stop = here + 12 + size
        if stop > len(blob) or first and (name, size) != (b"IHDR", 13):
            return None
        if zlib.crc32(blob[here + 4 : stop - 4]) != struct.unpack_from(">I", blob, stop - 4)[0]:
            return None
        if name == b"IEND":
            return stop
        here, first = stop, False
    return None


def gif_end(blob: bytes, at: int) -> int | None:
    if len(blob) < at + 14:
        return None
    width, height, flags = struct.unpack_from("<HHB", blob, at + 6)
    here = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    if not width or not height:
        return None
    while here < len(blob):
        kind = blob[here]
        if kind == 0x3B:
            return here + 1 if images else None
        if kind == 0x2C and here + 10 < len(blob):
            local = blob[here + 9]
            here += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
            images += 1
        elif kind == 0x21:
            here += 2
        else:
            return None
        while here < len(blob) and blob[here]:
            here += 1 + blob[here]
        here += 1
    return None


def bmp_end(blob: bytes, at: int) -> int | None:
    if len(blob) < at + 30:
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", blob, at + 2)
    planes, bits = struct.unpack_from("<HH", blob, at + 26)
    sound = not zero and header in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if sound and 14 + header <= offset < size <= len(blob) - at else None


def gzip_end(blob: bytes, at: int) -> int | None:
    if len(blob) < at + 18 or blob[at + 3] & 0xE0:
        return None
    reader = zlib.decompressobj(31)
    rest = memoryview(blob)[at:]
    try:
        more = rest
        while not reader.eof and len(more):
            reader.decompress(more, 1 << 20)
            more = reader.unconsumed_tail
    except zlib.error:
        return None
    return len(blob) - len(reader.unused_data) if reader.eof else None


def pdf_end(blob: bytes, at: int) -> int | None:
    if not blob[at + 5 : at + 8].replace(b".", b"", 1).isdigit():
        return None
    mark = blob.find(b"%%EOF", at)
    start = blob.rfind(b"startxref", at, mark) if mark >= 0 else -1
    number = blob[start + 9 : mark].strip() if start >= 0 else b""
    if not number.isdigit() or not blob[at + int(number) : at + int(number) + 4] == b"xref":
        return None
    return mark + 5


def webp_end(blob: bytes, at: int) -> int | None:
    if len(blob) < at + 20 or blob[at + 8 : at + 12] != b"WEBP" or blob[at + 12 : at + 16] not in (b"VP8 ", b"VP8L", b"VP8X"):
        return None
    end, here = at + 8 + struct.unpack_from("<I", blob, at + 4)[0], at + 12
    while here + 8 <= end <= len(blob):
        size = struct.unpack_from("<I", blob, here + 4)[0]
        here += 8 + size + size % 2
    return end if here == end else None


def jpeg_end(blob: bytes, at: int) -> int | None:
    """Segments up to the end marker; a frame header with a size must come before the first scan."""
    here, framed = at + 2, False
    while here + 4 <= len(blob) and blob[here] == 0xFF:
        marker, size = blob[here + 1], struct.unpack_from(">H", blob, here + 2)[0]
        if marker == 0xD9:
            return None  # an end without a scan
        if size < 2 or here + 2 + size > len(blob) or marker < 0xC0:
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", blob, here + 5) if size >= 8 else (0, 0)
            framed = bool(width)
        here += 2 + size
        if marker == 0xDA:
            if not framed:
                return None
            while True:  # coded data: an FF is followed by 00 or a restart, else it is the next marker
                here = blob.find(b"\xff", here)
                if here < 0 or here + 2 > len(blob):
                    return None
                if blob[here + 1] == 0xD9:
                    return here + 2
                if blob[here + 1] and not 0xD0 <= blob[here + 1] <= 0xD7:
                    break
                here += 2
    return None


def zip_end(blob: bytes, at: int) -> int | None:
    """The end record whose directory begins where it says and lists entries that stand where it says."""
    mark = blob.find(b"PK\x05\x06", at)
    while mark >= 0 and mark + 22 <= len(blob):
        count, size, offset, comment = struct.unpack_from("<HIIH", blob, mark + 10)
        here = at + offset
        if here + size == mark and mark + 22 + comment <= len(blob):
            for _ in range(count):
                if here + 46 > mark or blob[here : here + 4] != b"PK\x01\x02":
                    return None
                name, extra, note = struct.unpack_from("<HHH", blob, here + 28)
                local = at + struct.unpack_from("<I", blob, here + 42)[0]
                if blob[local : local + 4] != b"PK\x03\x04":
                    return None
                here += 46 + name + extra + note
            return mark + 22 + comment if here == mark and count else None
        mark = blob.find(b"PK\x05\x06", mark + 4)
    return None


def mp4_end(blob: bytes, at: int) -> int | None:
    """Boxes from the file type on, as long as they are sound; one of them must be the movie's."""
    here, found = at, set()
    while here + 8 <= len(blob):
        size, name = struct.unpack_from(">I4s", blob, here)
        if size == 1 and here + 16 <= len(blob):
            size = struct.unpack_from(">Q", blob, here + 8)[0]
        if size < 8 or here + size > len(blob) or not name.isalnum():
            break
        found.add(name)
        here += size
    return here if b"ftyp" in found and b"moov" in found else None


def ogg_end(blob: bytes, at: int) -> int | None:
    """The pages of one stream, numbered from its first to its last."""
    here, number, stream = at, 0, None
    while here + 27 <= len(blob) and blob[here : here + 5] == b"OggS\0":
        flags, (serial, page) = blob[here + 5], struct.unpack_from("<II", blob, here + 14)
        table = blob[here + 27 : here + 27 + blob[here + 26]]
        stop = here + 27 + len(table) + sum(table)
        if len(table) < blob[here + 26] or stop > len(blob) or page != number or bool(flags & 2) != (number == 0) or stream not in (None, serial):
            return None
        if flags & 4:
            return stop
        here, number, stream = stop, number + 1, serial
    return None


#: Kilobits a second and samples a second of layer III, by the header's index; MPEG 1 and 2.
BITRATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000)}


def mp3_end(blob: bytes, at: int) -> int | None:
    """Frames that follow each other, three at least, perhaps after a tag."""
    here, frames = at, 0
    if blob[at : at + 3] == b"ID3":
        if len(blob) < at + 10 or any(x & 0x80 for x in blob[at + 6 : at + 10]):
            return None
        here = at + 10 + sum(x << 7 * k for k, x in enumerate(reversed(blob[at + 6 : at + 10])))
    while here + 4 <= len(blob) and blob[here] == 0xFF and blob[here + 1] & 0xE6 == 0xE2:
        version, rate, samples = blob[here + 1] >> 3 & 3, blob[here + 2] >> 4, blob[here + 2] >> 2 & 3
        if version not in BITRATES or not 0 < rate < 15 or samples == 3:
            break
        size = (144 if version == 3 else 72) * BITRATES[version][rate] * 1000 // SAMPLES[version][samples] + (blob[here + 2] >> 1 & 1)
        if here + size > len(blob):
            break
        here, frames = here + size, frames + 1
    return here if frames >= 3 else None


#: Magic bytes, where in the medium they stand, type and validator of each known format.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int | None]]] = [
    (b"RIFF", 0, "audio/wav", wave_end),
    (b"RIFF", 0, "image/webp", webp_end),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png_end),
    (b"GIF87a", 0, "image/gif", gif_end),
    (b"GIF89a", 0, "image/gif", gif_end),
    (b"BM", 0, "image/bmp", bmp_end),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg_end),
    (b"ftyp", 4, "video/mp4", mp4_end),
    (b"OggS", 0, "application/ogg", ogg_end),
    (b"ID3", 0, "audio/mpeg", mp3_end),
    (b"\xff\xfa", 0, "audio/mpeg", mp3_end),
    (b"\xff\xfb", 0, "audio/mpeg", mp3_end),
    (b"\xff\xf2", 0, "audio/mpeg", mp3_end),
    (b"\xff\xf3", 0, "audio/mpeg", mp3_end),
    (b"PK\x03\x04", 0, "application/zip", zip_end),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzip_end),
    (b"%PDF-", 0, "application/pdf", pdf_end),
]


def automaton():
    """The automaton over all magic bytes; bytes are read as Latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in {magic for magic, *_ in FORMATS}:
        found.add_word(magic.decode("latin-1"), [(len(magic) + place, kind, end) for m, place, kind, end in FORMATS if m == magic])
    found.make_automaton()
    return found


def sniff(blob: bytes, magics) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media: the one at offset 0, then those that begin
    further in and not within one another. What is of the type of the first and ends with it is
    its own tail."""
    media, free = [], 0
    for last, formats in magics.iter(blob.decode("latin-1")):
        for size, kind, end in formats:
            at = last - size + 1
            if at >= free and (stop := end(blob, at)) is not None and (kind, 0, stop) not in media:
                media.append((kind, at, stop - at))
                free = 1 if at == 0 else stop
                break
    return media


STORED = "doc_id bigint, n_bytes bigint, declared string, media binary"
STORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])
READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, type string, corrected boolean"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("type", pa.string()), ("corrected", pa.bool_())])
CARVED = "doc_id bigint, type string, offset bigint, length bigint, medium binary"
CARVED_ARROW = pa.schema([("doc_id", pa.int64()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("medium", pa.binary())])


def store(docs: DataFrame, declared: str = UNKNOWN) -> DataFrame:
    """doc_id, n_bytes, declared, media: the texts as WAVE files, written and reread."""

    def encode(batches):
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                raw = text.encode("utf-8")
                payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")
                yield doc_id, len(raw), declared, wave(payload)

        yield from out_batches(rows(), STORED_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return spool(rows.mapInArrow(encode, STORED), "media")


def features(media: DataFrame) -> DataFrame:
    """What the stored media hold: the payload of the WAVE file and all that was found in the blob."""

    def decode(batches):
        magics = automaton()

        def rows() -> Iterator[tuple]:
            for doc_id, n_bytes, declared, blob in rows_of(batches, "doc_id", "n_bytes", "declared", "media"):
                found = sniff(blob, magics)
                kind = found[0][0] if found and found[0][1] == 0 else UNKNOWN
                start, size = wave_chunks(blob, 0)[b"data"] if kind == "audio/wav" else (0, len(blob))
                payload = blob[start : start + size]
                inner = [f"{k}@{at}+{n}" for k, at, n in found if at]
                mean = np.frombuffer(payload, np.uint8).mean() if payload else 0.0
                feature = f"type={kind};length={found[0][2] if kind != UNKNOWN else len(blob)};samples={len(payload)};mean={mean:.6f};embedded={','.join(inner)}"
                yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, kind, kind != declared

        yield from out_batches(rows(), READ_ARROW)

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(decode, READ)


def carve(media: DataFrame) -> DataFrame:
    """One row for each embedded medium: doc_id, type, offset, length, medium."""

    def cut(batches):
        magics = automaton()

        def rows() -> Iterator[tuple]:
            for doc_id, blob in rows_of(batches, "doc_id", "media"):
                for kind, at, n in sniff(blob, magics):
                    if at:
                        yield doc_id, kind, at, n, blob[at : at + n]

        yield from out_batches(rows(), CARVED_ARROW)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(cut, CARVED)
