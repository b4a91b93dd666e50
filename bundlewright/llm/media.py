"""Operator 3: media columns, by signatures and validators.

One Aho-Corasick automaton finds the magic bytes of all formats in a value. At
each place found the format's validator reads the structure that follows, up to
its end: lengths and checksums must hold. What stands at the start and takes up
the value decides its type, whatever was declared; objects found further on are carved.
``;base64,`` is a signature too: what follows is decoded and validated alike. It may be wrapped by line ends, have the letters
for URLs or percent signs; as much of it counts as encodes the object.

Types without magic bytes are told from the whole value: markup, text, or other
bytes. Objects don't overlap: what lies within one that was confirmed is part of it. Formats with validators are those of
``SIGNATURES``. A declared type is corrected if the bytes tell another, or if it has a validator and the bytes don't pass; bytes that are merely
unknown don't speak against a type that has none, such as FLAC.

Defined cases: a null value has null type and length and nothing embedded; an empty
one is ``application/x-empty``; a null declared type is never right; an object that is
cut short is not confirmed; values of any length are read whole; repeated rows each give a row; an empty
table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import urllib.parse
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.llm.common import sole, table

_BMP_HEADERS = {12, 16, 40, 52, 56, 64, 108, 124}


def png(b: bytes, at: int) -> tuple[str, int] | None:
    """Chunks with right checksums, from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(memoryview(b)[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", end - at
        i, first = end, False
    return None


def gif(b: bytes, at: int) -> tuple[str, int] | None:
    """The screen, its colours, then blocks up to the trailer, with at least one image."""
    if len(b) < at + 13:
        return None
    flags, i, images = b[at + 10], at + 13, 0
    i += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return ("image/gif", i + 1 - at) if images else None
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 <= len(b):
            local = b[i + 9]
            i += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            images += 1
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    """Segments by their lengths, a frame before the scan, and scan data up to the end mark."""
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark == 0xD9 or mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return None
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if mark == 0xDA:
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                after = b[i + 1]
                if after == 0 or 0xD0 <= after <= 0xD7:
                    i += 2
                elif after == 0xFF:
                    i += 1
                else:
                    break
            if b[i + 1] == 0xD9:
                return ("image/jpeg", i + 2 - at) if frame else None
    return None


def riff(b: bytes, at: int) -> tuple[str, int] | None:
    """A known form whose chunks fill the length given."""
    if len(b) < at + 12:
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(form)
    end, i, chunks = at + 8 + size, at + 12, 0
    if kind is None or end > len(b):
        return None
    while i + 8 <= end:
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
        chunks += 1
    return (kind, end - at) if chunks and i in (end, end + 1) else None


def bmp(b: bytes, at: int) -> tuple[str, int] | None:
    """Known header sizes, no reserved bits, and pixels within the length given."""
    if len(b) < at + 26:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    if reserved or header not in _BMP_HEADERS or not 14 + header <= pixels <= size or at + size > len(b):
        return None
    return "image/bmp", size


def pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """A version, a cross-reference and the last end mark before another header."""
    if not re.compile(rb"%PDF-\d\.\d[\s%]").match(b, at):
        return None
    until = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, until if until >= 0 else len(b))
    if end < 0 or b.rfind(b"startxref", at, end) < 0:
        return None
    end += 5
    end += 2 if b[end : end + 2] == b"\r\n" else 1 if b[end : end + 1] in (b"\r", b"\n") else 0
    return "application/pdf", end - at


def _directory(b: bytes, end: int) -> tuple[int, int] | None:
    """(start, end) of the archive that an end record at ``end`` closes: its directory has the entries and the place that the record says."""
    if end + 22 > len(b):
        return None
    entries, size, start, note = struct.unpack_from("<HIIH", b, end + 10)
    after, closes = end + 22 + note, end
    if (entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20 and b[end - 20 : end - 16] == b"PK\x06\x07":
        # A 64-bit record stands before its locator, of 56 bytes at least; its own length is in it.
        closes = b.rfind(b"PK\x06\x06", max(0, end - 20 - (1 << 16)), end - 20)
        if closes < 0 or closes + 56 > end - 20 or closes + 12 + struct.unpack_from("<Q", b, closes + 4)[0] != end - 20:
            return None
        entries, size, start = struct.unpack_from("<QQQ", b, closes + 32)
    first, i = closes - size - start, closes - size
    if first < 0 or after > len(b) or entries > size // 46:
        return None
    for _ in range(entries):
        if i + 46 > closes or b[i : i + 4] != b"PK\x01\x02":
            return None
        i += 46 + sum(struct.unpack_from("<HHH", b, i + 28))
    return (first, after) if i == closes else None


def archive(b: bytes, at: int) -> tuple[str, int] | None:
    """A zip archive, plain or of 64 bits: the directory's place and entries agree with its end record."""
    end = _archives(b).get(at)
    return None if end is None else ("application/zip", end - at)


_LAST: list = [None, {}]


def _archives(b: bytes) -> dict[int, int]:
    """Start to end of every archive of a value; its end records are looked for once."""
    if _LAST[0] is not b:
        found, at = {}, b.find(b"PK\x05\x06")
        while at >= 0:
            if place := _directory(b, at):
                found.setdefault(*place)
            at = b.find(b"PK\x05\x06", at + 4)
        _LAST[:] = b, found
    return _LAST[1]


def gzipped(b: bytes, at: int) -> tuple[str, int] | None:
    """A stream that can be inflated up to its checksum."""
    machine, view, i = zlib.decompressobj(31), memoryview(b), at
    try:
        while not machine.eof:
            if machine.unconsumed_tail:
                machine.decompress(machine.unconsumed_tail, 1 << 20)
            elif i < len(b):
                machine.decompress(view[i : i + (1 << 16)], 1 << 20)
                i += min(1 << 16, len(b) - i)
            else:
                return None
    except zlib.error:
        return None
    return "application/gzip", i - len(machine.unused_data) - at


def boxes(b: bytes, at: int) -> tuple[str, int] | None:
    """ISO media: a file type box, then boxes by their lengths, one of them with a movie or data."""
    at -= 4
    if at < 0:
        return None
    i, seen = at, []
    while i + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        head = 8
        if size == 1 and i + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, i + 8)[0], 16
        elif size == 0:
            size = len(b) - i
        if size < head or i + size > len(b) or not re.fullmatch(rb"[ -~]{4}", kind) or (seen and kind == b"ftyp"):
            break
        seen.append(kind)
        i += size
    if seen[:1] != [b"ftyp"] or not {b"moov", b"mdat", b"moof", b"meta"} & set(seen):
        return None
    return ("image/heif" if b[at + 8 : at + 12] in (b"heic", b"mif1", b"avif") else "video/mp4"), i - at


@lru_cache(1)
def _ogg_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


def ogg(b: bytes, at: int) -> tuple[str, int] | None:
    """Pages with right checksums, the first of which starts a stream."""
    i, known = at, _ogg_table()
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b):
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if end > len(b) or (i == at and not b[i + 5] & 2):
            break
        crc = 0
        for k in b[i : i + 22] + b"\0\0\0\0" + b[i + 26 : end]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ known[crc >> 24 ^ k]
        if crc != struct.unpack_from("<I", b, i + 22)[0]:
            break
        i = end
    return ("audio/ogg", i - at) if i > at else None


_TIFF_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)


def tiff(b: bytes, at: int) -> tuple[str, int] | None:
    """Directories in a chain, their values and the strips or tiles that they name; the last byte of any of these is the end."""
    order = "<" if b[at : at + 2] == b"II" else ">"
    end, seen, strips = at + 8, set(), 0
    place = struct.unpack_from(order + "I", b, at + 4)[0] if at + 8 <= len(b) else 0
    while place:
        i = at + place
        if place < 8 or i in seen or i + 2 > len(b):
            return None
        seen.add(i)
        n = struct.unpack_from(order + "H", b, i)[0]
        if not n or i + 2 + 12 * n + 4 > len(b):
            return None
        places, sizes = [], []
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", b, i + 2 + 12 * k)
            if not 1 <= kind <= 12:
                return None
            size = _TIFF_SIZES[kind] * count
            where = i + 2 + 12 * k + 8 if size <= 4 else at + value
            if where + size > len(b):
                return None
            end = max(end, where + size)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                (places if tag in (273, 324) else sizes).extend(struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, where))
        if len(places) != len(sizes) or any(at + p + n > len(b) for p, n in zip(places, sizes)):
            return None
        strips += len(places)
        end = max([end, i + 6 + 12 * n, *(at + p + n for p, n in zip(places, sizes))])
        place = struct.unpack_from(order + "I", b, i + 2 + 12 * n)[0]
    return ("image/tiff", end - at) if strips else None


_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_BITRATES = {True: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), False: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}


def mp3(b: bytes, at: int) -> tuple[str, int] | None:
    """A tag, then frames of layer 3 one after another, two at least, and an old tag at the end if there is one."""
    if len(b) < at + 10 or max(b[at + 6 : at + 10]) > 0x7F:
        return None
    i = at + 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9])
    frames = 0
    while i + 4 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xE6 == 0xE2:
        version, rate, bits = b[i + 1] >> 3 & 3, b[i + 2] >> 2 & 3, b[i + 2] >> 4
        if version == 1 or rate == 3 or bits in (0, 15):
            break
        size = (144 if version == 3 else 72) * 1000 * _BITRATES[version == 3][bits] // _RATES[version][rate] + (b[i + 2] >> 1 & 1)
        if i + size > len(b):
            break
        i, frames = i + size, frames + 1
    if frames < 2:
        return None
    i += 128 if b[i : i + 3] == b"TAG" and i + 128 <= len(b) else 0
    return "audio/mpeg", i - at


def _element(b: bytes, at: int) -> tuple[int, int, bool] | None:
    """(where its data starts, their length, whether that is known) of an EBML element."""
    if at + 2 > len(b) or not b[at] or not b[at + (n := 9 - b[at].bit_length()) : at + n + 1]:
        return None
    width = 9 - b[at + n].bit_length() if b[at + n] else 9
    if n > 4 or width > 8 or at + n + width > len(b):
        return None
    size = int.from_bytes(b[at + n : at + n + width], "big") & ((1 << 7 * width) - 1)
    return at + n + width, size, size != (1 << 7 * width) - 1


def ebml(b: bytes, at: int) -> tuple[str, int] | None:
    """A header that names its kind, then a segment of known length."""
    head = _element(b, at)
    if not head or not head[2] or head[0] + head[1] > len(b):
        return None
    found = re.compile(rb"\x42\x82.(webm|matroska)", re.S).search(b, head[0], head[0] + head[1])
    after = head[0] + head[1]
    if not found or b[after : after + 4] != b"\x18\x53\x80\x67":
        return None
    body = _element(b, after)
    if not body or not body[2] or not body[1] or body[0] + body[1] > len(b):
        return None
    return ("video/webm" if found[1] == b"webm" else "video/x-matroska"), body[0] + body[1] - at


def icon(b: bytes, at: int) -> tuple[str, int] | None:
    """A directory whose entries name bitmaps or PNGs after it."""
    n = struct.unpack_from("<H", b, at + 4)[0] if at + 6 <= len(b) else 0
    first = end = at + 6 + 16 * n
    if not n or first > len(b):
        return None
    for k in range(n):
        reserved, size, place = struct.unpack_from("<3xBxxxxII", b, at + 6 + 16 * k)
        i = at + place
        if reserved or i < first or not size or i + size > len(b) or not (b[i : i + 4] == struct.pack("<I", 40) or png(b, i)):
            return None
        end = max(end, i + size)
    return "image/x-icon", end - at


#: Magic bytes and the validators of what they start.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": png,
    b"GIF87a": gif,
    b"GIF89a": gif,
    b"\xff\xd8\xff": jpeg,
    b"RIFF": riff,
    b"BM": bmp,
    b"%PDF-": pdf,
    b"PK\x03\x04": archive,
    b"\x1f\x8b\x08": gzipped,
    b"ftyp": boxes,
    b"OggS": ogg,
    b"II*\0": tiff,
    b"MM\0*": tiff,
    b"ID3": mp3,
    b"\x1a\x45\xdf\xa3": ebml,
    b"\0\0\1\0": icon,
}
#: Types that a value has only if a validator says so.
VALIDATED = frozenset(
    "image/png image/gif image/jpeg audio/wav image/webp video/x-msvideo image/bmp application/pdf application/zip application/gzip image/heif video/mp4"
    " audio/ogg image/tiff audio/mpeg video/webm video/x-matroska image/x-icon".split()
)
_INLINE = b";base64,"
_BASE64 = re.compile(rb"(?:[A-Za-z0-9+/_-]|%2[BbFf]|%0[AaDd]|(?:\r?\n[ \t]*))+(?:(?:=|%3[Dd]){0,2})")
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]+")
_MARKUP = re.compile(rb"\s*(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body|title|script|style|table|div|p|h1|meta)\b", re.I | re.S)
_XML = re.compile(rb"\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*|<!doctype[^>]*>\s*)*<([a-z]\w*)", re.I | re.S)


@lru_cache(1)
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for magic in (*SIGNATURES, _INLINE):
        machine.add_word(magic.decode("latin-1"), magic)
    machine.make_automaton()
    return machine


def objects(value: bytes) -> list[tuple[int, int, str, str]]:
    """(offset, length, type, coding) of the confirmed objects in a value, in order; none lies in another.

    The coding is ``raw``, or ``base64`` where offset and length are those of the encoded bytes.
    """
    out, free = [], 0
    for last, magic in _automaton().iter(value.decode("latin-1")):
        at = last + 1 - len(magic)
        if magic == _INLINE:
            found = _BASE64.match(value, last + 1)
            if last + 1 >= free and found:
                inner = _decoded(found[0])
                whole = inner and _whole(inner)
                if whole:
                    size = _encoded_size(found[0], whole[1])
                    out.append((last + 1, size, whole[0], "base64"))
                    free = last + 1 + size
            continue
        start = at - 4 if magic == b"ftyp" else at
        if start < free:
            continue
        found = SIGNATURES[magic](value, at)
        if found:
            out.append((start, found[1], found[0], "raw"))
            free = start + found[1]
    return out


def _letters_of(data: bytes) -> bytes:
    """The 64 letters of base64 that stand for bytes: without breaks and fillers, those for URLs replaced."""
    if b"%" in data:
        data = urllib.parse.unquote_to_bytes(data)
    return _NOT_BASE64.sub(b"", data.replace(b"-", b"+").replace(b"_", b"/"))


def _decoded(data: bytes) -> bytes | None:
    data = _letters_of(data)
    data = data[: len(data) - (len(data) % 4 == 1)]
    return base64.b64decode(data + b"=" * (-len(data) % 4)) if data else None


_UNIT = re.compile(rb"%[0-9A-Fa-f]{2}|.", re.S)


def _encoded_size(data: bytes, n: int) -> int:
    """How many of the bytes encode the first ``n``, with fillers."""
    letters, want = 0, -(-4 * n // 3)
    if len(_letters_of(data)) - want < 4 and not _NOT_BASE64.search(data.rstrip(b"=")):
        return len(data)
    for unit in _UNIT.finditer(data):
        letters += len(_letters_of(unit[0]))
        if letters == want:
            fillers = re.compile(rb"(?:=|%3[Dd]){0,2}").match(data, unit.end())
            return fillers.end()
    return len(data)


def _whole(value: bytes) -> tuple[str, int] | None:
    """The type and length of an object that stands at the start."""
    for magic, validate in SIGNATURES.items():
        at = 4 if magic == b"ftyp" else 0
        if value.startswith(magic, at) and (found := validate(value, at)):
            return found
    return None


def sniff(value: bytes | None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """(type, embedded objects)."""
    if value is None:
        return None, []
    found = objects(value)
    if found and found[0][0] == 0 and found[0][3] == "raw":
        return found[0][2], found[1:]
    if not value:
        return "application/x-empty", []
    if _MARKUP.match(value):
        return "text/html", found
    if xml := _XML.match(value):
        return ("image/svg+xml" if xml[1].lower() == b"svg" else "application/xml"), found
    try:
        text = value.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream", found
    return ("application/octet-stream" if "\0" in text else "text/plain"), found


def is_wrong(declared: str | None, sniffed: str) -> bool:
    """Whether a declared type is to be corrected."""
    return declared != sniffed and (declared is None or sniffed != "application/octet-stream" or declared in VALIDATED or declared.startswith("text/"))


_EMBEDDED = "array<struct<offset: long, length: long, type: string, coding: string>>"


def sniffed(media: DataFrame, id_col: str, value: str, declared: str) -> DataFrame:
    """(id, declared_type, sniffed_type, corrected, n_bytes, embedded); no row is shuffled."""
    narrow = sole(media, id_col, value, declared).toDF("id", "value", "declared_type")
    narrow = narrow.withColumn("value", F.col("value").cast("binary"))
    kind = narrow.schema["id"].dataType.simpleString()
    lists = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("coding", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, sizes = [], []
            for v in batch.column("value"):
                raw = v.as_py()
                done.append(sniff(raw))
                sizes.append(None if raw is None else len(raw))
            types = [t for t, _ in done]
            wrong = [None if t is None else is_wrong(d, t) for t, d in zip(types, batch.column("declared_type").to_pylist())]
            found = [[dict(zip(("offset", "length", "type", "coding"), x)) for x in e] for _, e in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("declared_type"), pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(found, lists)],
                ["id", "declared_type", "sniffed_type", "corrected", "n_bytes", "embedded"],
            )

    schema = f"id {kind}, declared_type string, sniffed_type string, corrected boolean, n_bytes long, embedded {_EMBEDDED}"
    return narrow.mapInArrow(run, schema)


def carved(media: DataFrame, id_col: str, value: str) -> DataFrame:
    """(id, offset, type, data): each embedded object by itself, decoded."""
    narrow = sole(media, id_col, value).toDF("id", "value").withColumn("value", F.col("value").cast("binary"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in enumerate(batch.column("value")):
                raw = v.as_py()
                parts = [(at, kind, _decoded(raw[at : at + n]) if coding == "base64" else raw[at : at + n]) for at, n, kind, coding in sniff(raw)[1]]
                if parts:
                    at, types, data = zip(*parts)
                    ids = batch.column("id").take(pa.array([i] * len(parts)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array(types, pa.string()), pa.array(data, pa.binary())], ["id", "offset", "type", "data"])

    return narrow.mapInArrow(run, f"id {kind}, offset long, type string, data binary")


_BY_NAME = {"png": "image/png", "gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "wav": "audio/wav", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "mp4": "video/mp4", "ogg": "audio/ogg", "svg": "image/svg+xml", "xml": "application/xml", "txt": "text/plain"}


def declared_by_url(url: str):
    """The type that the end of a URL's path stands for; ``text/html`` if for none."""
    ending = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^(?![A-Za-z][\w+.-]*://[^/?#]*(?:[?#]|$))[^?#]*/[^/?#]*\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    known = F.create_map(*(F.lit(x) for pair in _BY_NAME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ending), F.lit("text/html"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def as_png(data: bytes) -> bytes:
    """A picture of one pixel with ``data`` as a private chunk; 69 bytes more."""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + _chunk(b"daTa", data) + _chunk(b"IDAT", b"") + _chunk(b"IEND", b"")


def as_wav(data: bytes) -> bytes:
    """``data`` as 8-bit sound; 44 bytes more and one if it is odd."""
    size = len(data) + len(data) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(data))
    return head + data + b"\0" * (len(data) % 2)


def as_gzip(data: bytes) -> bytes:
    """``data`` stored as it is; 18 bytes more and five for each 65,535."""
    parts = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    stored = b"".join(bytes([i == len(parts) - 1]) + struct.pack("<HH", len(p), len(p) ^ 0xFFFF) + p for i, p in enumerate(parts))
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + stored + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def media_column(pages: DataFrame, id_col: str = "page_id", text: str = "html") -> DataFrame:
    """(id, declared, value): the bytes of each page as media of several kinds, by its id's remainder.

    0 the page itself; 1 a picture declared as another format; 2 gzip; 3 the page with a sound after it; 4 the page with a picture as wrapped base64;
    5 a sound declared as another; 6 the page, a picture and gzip; 7 a picture that lacks its last byte. A null text is a null value.
    """
    narrow = sole(pages, id_col, text).toDF("id", "text").withColumn("text", F.col("text").cast("binary"))
    kind = narrow.schema["id"].dataType.simpleString()
    declared = ("text/html", "image/jpeg", "application/gzip", "text/html", "text/html", "audio/mpeg", "text/html", "image/png")

    def inline(d: bytes) -> bytes:
        return d + b"<img src='data:image/gif;base64," + base64.encodebytes(as_png(d)).rstrip(b"\n") + b"'>"

    made = (bytes, as_png, as_gzip, lambda d: d + as_wav(d), inline, as_wav, lambda d: d + as_png(d) + as_gzip(d), lambda d: as_png(d)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [(i or 0) % 8 for i in batch.column(0).to_pylist()]
            for at in range(0, len(ids), 256):
                some = ids[at : at + 256]
                values = [None if v is None else made[k](v) for k, v in zip(some, batch.column(1).slice(at, 256).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([declared[k] for k in some]), pa.array(values, pa.binary())], ["id", "declared", "value"])

    return narrow.mapInArrow(run, f"id {kind}, declared string, value binary")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages hold no media themselves, so each is made into some (:func:`media_column`)."""
    found = sniffed(media_column(table(spark, sf_dir, "pages")), "id", "value", "declared")
    each = F.transform("embedded", lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["type"], x["coding"]))
    return found.select(F.col("id").alias("page_id"), "declared_type", "sniffed_type", "corrected", "n_bytes", F.array_join(each, ",").alias("embedded"))


#: The same from the pages' lengths alone, for ids of 0 or more and pages that are markup.
SQL = """
WITH sized AS (SELECT page_id, page_id % 8 AS k, octet_length(encode(html)) AS n FROM pages),
made AS (SELECT *, n + 69 AS png, 44 + n + n % 2 AS wav, 18 + n + 5 * greatest(1, ceil(n / 65535))::BIGINT AS gz FROM sized),
coded AS (SELECT *, 4 * ((png + 2) // 3) AS letters FROM made),
wrapped AS (SELECT *, letters + (letters - 1) // 76 AS inline FROM coded)
SELECT page_id, ['text/html', 'image/jpeg', 'application/gzip', 'text/html', 'text/html', 'audio/mpeg', 'text/html', 'image/png'][k + 1] AS declared_type,
  ['text/html', 'image/png', 'application/gzip', 'text/html', 'text/html', 'audio/wav', 'text/html', 'application/octet-stream'][k + 1] AS sniffed_type,
  k IN (1, 5, 7) AS corrected,
  [n, png, gz, n + wav, n + 32 + inline + 2, wav, n + png + gz, png - 1][k + 1]::BIGINT AS n_bytes,
  CASE k WHEN 3 THEN concat(n, ':', wav, ':audio/wav:raw') WHEN 4 THEN concat(n + 32, ':', inline, ':image/png:base64')
    WHEN 6 THEN concat(n, ':', png, ':image/png:raw,', n + png, ':', gz, ':application/gzip:raw') ELSE '' END AS embedded
FROM wrapped"""

QUERIES = {"op3_media_columns": op3_media_columns}
ORACLES = {"op3_media_columns": SQL}
