"""Builders of small image files, byte by byte."""

import os
import struct

EXIF, GPS, SUB = 0x8769, 0x8825, 0x014A


def rational(x, signed=False, scale=1000):
    return (10 if signed else 5), [(round(x * scale), scale)]


def entry_bytes(order, kind, values):
    if kind == 2:
        return values.encode() + b"\0", len(values.encode()) + 1
    code = {1: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}[kind]
    flat = [y for v in values for y in (v if isinstance(v, tuple) else (v,))]
    return struct.pack(order + code[0] * len(flat), *flat), len(values)


def tiff(image=(), exif=(), gps=(), order="<", magic=42, pad=0):
    """A TIFF block with entries (tag, type, values) in its three directories."""
    mark = b"II" if order == "<" else b"MM"
    places = {}
    out = bytearray(mark + struct.pack(order + "HI", magic, 8 + pad) + b"\0" * pad)

    def directory(entries, pointers):
        start, n = len(out), len(entries) + len(pointers)
        body, extra = bytearray(), bytearray()
        base = start + 2 + 12 * n + 4
        for tag, kind, values in entries:
            data, count = entry_bytes(order, kind, values)
            if len(data) <= 4:
                field = data.ljust(4, b"\0")
            else:
                field = struct.pack(order + "I", base + len(extra))
                extra.extend(data)
            body += struct.pack(order + "HHI", tag, kind, count) + field
        for tag in pointers:
            places[tag] = start + 2 + len(body) + 8
            body += struct.pack(order + "HHI", tag, 4, 1) + b"\0\0\0\0"
        out.extend(struct.pack(order + "H", n) + body + b"\0\0\0\0" + extra)
        return start

    directory(list(image), [t for t, e in ((EXIF, exif), (GPS, gps)) if e])
    for tag, entries in ((EXIF, exif), (GPS, gps)):
        if entries:
            at = directory(list(entries), [])
            struct.pack_into(order + "I", out, places[tag], at)
    return bytes(out)


def usual(i=0, **more):
    """A block with the usual tags; ``i`` varies them."""
    image = [(0x010F, 2, "ACME Optics"), (0x0110, 2, f"Box {i % 3}"), (0x0112, 3, [1])]
    exif = [
        (0x829A, 5, [(1, 60 * (1 + i % 5))]),
        (0x829D, *rational([1.8, 2.8, 4.0, 8.0][i % 4], scale=10)),
        (0x8827, 3, [100 * (1 + i % 8)]),
        (0x9003, 2, f"20{20 + i % 4}:0{1 + i % 9}:1{i % 9} 0{i % 10}:15:30"),
        (0x9011, 2, "+01:00"),
        (0x9209, 3, [i % 2]),
        (0x920A, *rational([23, 35, 50, 85][i % 4])),
        (0xA002, 4, [6000]),
        (0xA003, 4, [4000]),
        (0xA432, 5, [(18, 1), (55, 1), (28, 10), (4, 1)]),
        (0xA434, 2, f"Zoom {i % 2}"),
    ]
    gps = [(1, 2, "S"), (2, 5, [(33, 1), (51, 1), (3155, 100)]), (3, 2, "E"), (4, 5, [(151, 1), (12, 1), (3348, 100)])] if i % 2 == 0 else []
    return tiff(image, exif, gps, **more)


def jpeg(block, before=b"", tail=4000):
    app1 = b"Exif\0\0" + block
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda" + b"\x55" * tail


def png(block):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"eXIf", block) + chunk(b"IDAT", b"x" * 100)


def webp(block):
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    body = b"WEBP" + chunk(b"VP8X", b"\0" * 11) + chunk(b"EXIF", block)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, data, wide=False):
    return (struct.pack(">I4sQ", 1, kind, len(data) + 16) if wide else struct.pack(">I4s", len(data) + 8, kind)) + data


def heif(block, meta_last=False, wide=False, iloc=1):
    item = b"\0\0\0\0" + block
    infe = box(b"infe", struct.pack(">B3xHH4s", 2, 7, 0, b"Exif") + b"\0")
    iinf = box(b"iinf", struct.pack(">B3xH", 0, 1) + infe)
    ftyp = box(b"ftyp", b"heic\0\0\0\0heic")

    def meta(place):
        head = struct.pack(">B3xBB", iloc, 0x44, 0x00)
        own = struct.pack(">H", 1) + struct.pack(">H", 7) + (b"\0\0" if iloc else b"") + b"\0\0" + struct.pack(">HII", 1, place, len(item))
        return box(b"meta", b"\0\0\0\0" + iinf + box(b"iloc", head + own))

    if meta_last:
        place = len(ftyp) + (16 if wide else 8)
        return ftyp + box(b"mdat", item + b"\x11" * 50_000, wide) + meta(place)
    place = len(ftyp) + len(meta(0)) + 8
    return ftyp + meta(place) + box(b"mdat", item)


def write(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def write_library(folder, n):
    """n JPEG files in folders of 500."""
    for i in range(n):
        write(folder, f"{i // 500:03d}/img{i:06d}.jpg", jpeg(usual(i), tail=8000))
