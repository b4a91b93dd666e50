import base64
import gzip
import io
import random
import struct
import time
import wave
import zipfile
import zlib

from bundlewright.llm import media


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width=2):
    rows = b"".join(b"\0" + bytes(3 * width) for _ in range(2))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def jpeg():
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xC0, bytes(15)) + seg(0xDA, bytes(10)) + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(64))
    return out.getvalue()


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text " * 20)
    return out.getvalue()


def ogg():
    page = b"OggS\0\2" + bytes(8) + struct.pack("<II", 7, 0) + bytes(4) + bytes([1, 5]) + b"hello"
    crc = 0
    for k in page:
        crc = (crc << 8 & 0xFFFFFFFF) ^ media._ogg_table()[crc >> 24 ^ k]
    return page[:22] + struct.pack("<I", crc) + page[26:]


def tiff():
    pixels, n = bytes(range(12)), 3
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", n)
    for tag, value in ((256, 4), (273, 8 + 2 + 12 * n + 4), (279, len(pixels))):
        head += struct.pack("<HHII", tag, 4, 1, value)
    return head + struct.pack("<I", 0) + pixels


def mp3():
    frame = b"\xff\xfb\x90\x00"
    return b"ID3\4\0\0" + bytes([0, 0, 0, 5]) + b"title" + (frame + bytes(417 - 4)) * 3


def webm():
    head = b"\x42\x82\x84webm"
    return b"\x1a\x45\xdf\xa3" + bytes([0x80 | len(head)]) + head + b"\x18\x53\x80\x67" + b"\x40\x20" + bytes(32)


def icon():
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", 1, 1, 0, 0, 1, 24, 48, 22) + struct.pack("<I", 40) + bytes(44)


def archive64():
    entry = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0, 0, 1, 0) + b"a"
    listed = b"PK\1\2" + bytes(24) + struct.pack("<HHH", 1, 0, 0) + bytes(12) + b"a"
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(listed), len(entry))
    locator = b"PK\6\7" + struct.pack("<IQI", 0, len(entry) + len(listed), 1)
    return entry + listed + end64 + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


MADE = {
    "image/png": png(),
    "image/gif": gif(),
    "image/jpeg": jpeg(),
    "audio/wav": wav(),
    "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n9\n%%EOF\n",
    "application/zip": archive(),
    "application/gzip": gzip.compress(b"some text" * 50),
    "video/mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 24, b"mdat") + bytes(16),
    "audio/ogg": ogg(),
    "image/tiff": tiff(),
    "audio/mpeg": mp3(),
    "video/webm": webm(),
    "image/x-icon": icon(),
}


def test_each_format_alone_and_cut_short():
    for kind, data in MADE.items():
        assert media.sniff(data) == (kind, []), kind
        assert media.sniff(data[: len(data) // 2])[0] not in (kind,) and not media.sniff(data[: len(data) // 2])[1]
    assert media.sniff(archive64()) == ("application/zip", []) and media.objects(b"x" * 9 + archive64()) == [(9, len(archive64()), "application/zip", "raw")]
    assert {f for f, _ in ((media.sniff(d)[0], 0) for d in MADE.values())} <= media.VALIDATED


def test_base64_of_any_form():
    data = png(40)
    plain = base64.b64encode(data)
    forms = [plain, plain.rstrip(b"="), base64.encodebytes(data).rstrip(), plain.replace(b"+", b"%2B").replace(b"/", b"%2f").replace(b"=", b"%3D"), base64.urlsafe_b64encode(data), b"\r\n  ".join(plain[i : i + 60] for i in range(0, len(plain), 60))]
    for form in forms:
        for before, after in ((b"<a href='data:x/y;base64,", b"'>"), (b";base64,", b"")):
            assert media.objects(before + form + after) == [(len(before), len(form), "image/png", "base64")], form
    assert media.objects(b";base64," + plain.rstrip(b"=") + b"\nmoreWords\n")[0][2:] == ("image/png", "base64")


def test_many_signatures_that_start_nothing():
    value = b"PK\3\4" * 300_000 + b"BM\0" * 300_000 + b"%PDF-1.4 " * 100_000  # 3 MB
    began = time.perf_counter()
    assert media.sniff(value) == ("application/octet-stream", []) and time.perf_counter() - began < 20

def test_a_changed_byte_is_noticed():
    data = bytearray(png())
    data[45] ^= 1
    assert media.sniff(bytes(data))[0] == "application/octet-stream"


def test_carving_from_any_mix():
    rng = random.Random(8)
    for _ in range(60):
        parts, want, at = [b"text \x00 BM GIF89a RIFF %PDF- "], [], 28
        at = len(parts[0])
        for kind in rng.sample(sorted(MADE), 4):
            data = MADE[kind]
            want.append((at, len(data), kind, "raw"))
            filler = bytes(rng.choice(b"abc BM\n") for _ in range(rng.randint(8, 30)))
            parts += [data, filler]
            at += len(data) + len(filler)
        assert media.objects(b"".join(parts)) == want


def test_columns(spark):
    inline = b"<html><img src='data:image/gif;base64," + base64.b64encode(png()) + b"'></html>"
    rows = [(i, d, "image/png", "x") for i, d in enumerate(MADE.values())]
    rows += [(70, None, "image/png", "x"), (71, b"", None, "x"), (72, inline, "text/html", "x"), (73, b"plain", "text/html", "x"), (74, b"\xff\xfe\x00", None, "x"), (73, b"plain", "text/html", "x")]
    df = spark.createDataFrame(rows, "id long, body binary, declared string, sniffed_type string")
    got = {r.id: r for r in media.sniffed(df, "id", "body", "declared").collect()}
    for i, kind in enumerate(MADE):
        assert got[i].sniffed_type == kind and got[i].corrected == (kind != "image/png")
    assert not media.is_wrong("audio/flac", "application/octet-stream") and media.is_wrong("image/png", "application/octet-stream") and media.is_wrong(None, "text/plain")
    assert got[70].sniffed_type is None and got[70].corrected is None and got[70].embedded == []
    assert (got[71].sniffed_type, got[71].corrected) == ("application/x-empty", True)
    assert got[72].sniffed_type == "text/html" and not got[72].corrected and [(e.type, e.coding) for e in got[72].embedded] == [("image/png", "base64")]
    assert (got[73].sniffed_type, got[74].sniffed_type) == ("text/plain", "application/octet-stream")
    carved = media.carved(df, "id", "body").collect()
    assert [(r.id, r.type, bytes(r.data)) for r in carved] == [(72, "image/png", png())]
    assert media.sniffed(df.limit(0), "id", "body", "declared").count() == 0


def test_declared_by_url(spark):
    urls = [("http://a.b/x.PNG?y=1",), ("http://a.b/x",), ("http://a.png",), (None,), ("http://a.b/c.d/x#t.gif",)]
    df = spark.createDataFrame(urls, "url string").select(media.declared_by_url("url").alias("t"))
    assert [r.t for r in df.collect()] == ["image/png", "text/html", "text/html", "text/html", "text/html"]


def test_query_against_sql(spark, tmp_path):
    """The media made of pages, by their lengths alone; one page is over 2 MB."""
    import duckdb

    rows = [(i, "http://x", "<html>" + "é" * (i * 7 % 500) + "</html>", None) for i in range(64)] + [(65, "u", "<html>" + "y" * 2_500_000, 1), (66, "u", "<html>" + "z" * 70_001, 1), (3, "u", "<p>", 1), (3, "u", "<p>", 1)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, "page_id long, url string, html string, value int").write.parquet(f"{tmp_path}/d/pages.parquet")
    got = sorted(map(tuple, media.op3_media_columns(spark, f"{tmp_path}/d").collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/d/pages.parquet/*.parquet'")
    assert got == sorted(db.execute(media.SQL).fetchall())
    odd = spark.createDataFrame([(None, None), (7, None), (None, "<p>")], "page_id long, html string")
    assert [r.value is None for r in media.media_column(odd).collect()] == [True, True, False] and media.media_column(odd.limit(0)).count() == 0
