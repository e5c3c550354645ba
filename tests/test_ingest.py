"""Header parser, field rules, folder walk and the two readers."""

import io
import os
import struct
from datetime import datetime

import pytest

from shutterlake.sources import fields, headers, images

from .images import box, heif, jpeg, png, rational, tiff, usual, webp, write, write_library

OK = {"camera": "ACME Box 0", "lens": "Zoom 0", "lens_min": 18.0, "lens_max": 55.0, "focal": 23.0, "fnumber": 1.8, "iso": 100, "tz_minutes": 60, "flash": False, "orientation": 1, "width": 6000, "height": 4000, "taken": datetime(2020, 1, 10, 0, 15, 30)}
CONTAINERS = {"a.jpg": jpeg(usual()), "b.tif": usual(), "c.png": png(usual()), "d.webp": webp(usual()), "e.heic": heif(usual()), "f.heic": heif(usual(), True), "g.avif": heif(usual(), True, True), "h.hif": heif(usual(), iloc=0), "i.jpg": jpeg(usual(order=">")), "j.rw2": usual(magic=0x55), "k.orf": usual(magic=0x4F52, order=">"), "l.dng": jpeg(usual())}


@pytest.mark.parametrize("name", CONTAINERS)
def test_containers(tmp_path, name):
    row = images.read_file(write(tmp_path, name, CONTAINERS[name]))
    assert row["status"] == "ok" and {k: row[k] for k in OK} == OK
    assert (round(row["latitude"], 4), round(row["longitude"], 4)) == (-33.8588, 151.2093)
    assert row["exposure"] == 1 / 60 and row["bytes_read"] > 0


def test_values_past_the_kept_head(tmp_path):
    row = images.read_file(write(tmp_path, "far.tif", usual(pad=9000) + b"\0" * 5000))
    assert row["status"] == "ok" and row["lens"] == "Zoom 0" and row["bytes_read"] < 12_000


def test_header_only(tmp_path):
    used = {n: images.read_file(write(tmp_path, f"{n}.jpg", jpeg(usual(), tail=n)))["bytes_read"] for n in (10_000, 5_000_000)}
    assert used[10_000] == used[5_000_000] <= 4096


def test_statuses(tmp_path):
    def status(name, data):
        r = images.read_file(write(tmp_path, name, data))
        return r["status"], r["container"]

    assert status("x.raf", jpeg(usual())) == ("unsupported", "raf")
    assert status("x.jpg", b"FUJIFILM" + b"\0" * 90) == ("unsupported", "raf")
    assert status("y.jpg", b"nothing known here") == ("unsupported", "unknown")
    assert status("z.heic", box(b"ftyp", b"crx \0\0\0\0crx ")) == ("unsupported", "cr3")
    assert status("empty.jpg", b"") == ("no-exif", "unknown")
    assert status("plain.jpg", b"\xff\xd8\xff\xda") == ("no-exif", "jpeg")
    assert status("bare.jpg", jpeg(tiff([(0x0112, 3, [1])]))) == ("no-exif", "jpeg")
    assert images.read_file(str(tmp_path / "gone.jpg"))["status"] == "unreadable"
    big = b"II" + struct.pack("<HI", 43, 8) + b"\0" * 50
    assert status("big.tif", big) == ("no-exif", "tiff")


def test_broken_headers_end_in_a_status(tmp_path):
    for name, data in CONTAINERS.items():
        for cut in range(0, min(len(data), 700), 7):
            assert images.read_file(write(tmp_path, name, data[:cut]))["status"] in ("ok", "no-exif", "unsupported")
        for at in range(4, min(len(data), 400), 5):
            changed = data[:at] + b"\xff\xff\xff" + data[at + 3 :]
            assert images.read_file(write(tmp_path, name, changed))["status"] in ("ok", "no-exif", "unsupported")
    loop = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<HHHII", 1, 0x8769, 4, 1, 8) + b"\0\0\0\0"
    assert images.read_file(write(tmp_path, "loop.tif", loop))["status"] == "no-exif"
    for _ in range(50):
        assert images.read_file(write(tmp_path, "noise.jpg", b"\xff\xd8" + os.urandom(3000)))["status"] != "unreadable"


def test_allowance():
    meter = headers.Meter(io.BytesIO(b"x" * 2_000_000))
    with pytest.raises(headers.HeaderError):
        for i in range(100):
            meter.at(5000 * i + 4096, 5000)
    assert meter.used <= headers.FILE_ALLOWANCE


def test_nan_and_zero_denominators(tmp_path):
    block = tiff([(0x010F, 2, "A")], [(0x8827, 11, [float("nan")]), (0x920A, 5, [(1, 0)]), (0x829A, 5, [(0, 0)])])
    row = images.read_file(write(tmp_path, "n.jpg", jpeg(block)))
    assert row["status"] == "ok" and row["iso"] is None and row["focal"] is None and row["exposure"] is None


def test_first_value_of_a_tag_stays():
    block = tiff([(0x0110, 2, "One"), (0x0110, 2, "Two")])
    assert headers.tags(headers.View(block))["Model"] == "One"


def test_identity_one_directory_down():
    inner = struct.pack("<HHHI", 1, 0x0110, 2, 4) + b"Raw\0" + b"\0\0\0\0"
    outer = struct.pack("<HHHII", 1, 0x014A, 4, 1, 8 + 18) + b"\0\0\0\0"
    assert headers.tags(headers.View(b"II" + struct.pack("<HI", 42, 8) + outer + inner))["Model"] == "Raw"


@pytest.mark.parametrize(
    "tags, camera",
    [
        ({"Make": "NIKON CORPORATION", "Model": "NIKON Z 6"}, "NIKON Z 6"),
        ({"Make": "Canon", "Model": "EOS R5"}, "Canon EOS R5"),
        ({"Make": "unknown", "Model": "X"}, "X"),
        ({"Make": "Leica"}, "Leica"),
        ({"UniqueCameraModel": "Phone"}, "Phone"),
        ({"Make": "\x1b[2J", "Model": " a\x07  b "}, "[2J a b"),
        ({}, None),
    ],
)
def test_camera(tags, camera):
    assert fields.camera(tags) == camera


def test_lens():
    assert fields.lens({"LensModel": "50mm F1.4", "LensMake": "Sigma Corp"}) == "Sigma 50mm F1.4"
    assert fields.lens({"LensSpecification": [(24, 1), (70, 1), (28, 10), (28, 10)]}) == "24-70mm lens"
    assert fields.lens({"LensSpecification": [(35, 1), (35, 1)]}) == "35mm lens"
    assert fields.lens_range({"LensSpecification": [(70, 1), (24, 1)]}) == (24.0, 70.0)
    assert fields.lens_range({"LensSpecification": [(0, 1), (24, 1)]}) == (None, None)


def test_apex_fallbacks():
    assert fields.fnumber({"ApertureValue": (3, 1)}) == 2**1.5
    assert fields.exposure({"ShutterSpeedValue": (8, 1)}) == 1 / 256
    assert fields.fnumber({"FNumber": (0, 1), "ApertureValue": (21, 1)}) is None
    assert fields.exposure({"ExposureTime": (7200, 1)}) is None
    assert fields.iso({"ISOSpeedRatings": 65535, "ISOSpeed": 12800}) == 12800
    assert fields.iso({"ISOSpeedRatings": [400, 0]}) == 400


@pytest.mark.parametrize("text, at", [("2024:06:21 07:30:00", datetime(2024, 6, 21, 7, 30)), ("2024-06-21T07:30:60.5", datetime(2024, 6, 21, 7, 30, 59)), ("2024/06/21", datetime(2024, 6, 21)), ("0000:00:00 00:00:00", None), ("2024:13:01 00:00:00", None), ("1700:01:01", None), ("junk", None), (None, None)])
def test_clock(text, at):
    assert fields.clock(text) == at


@pytest.mark.parametrize("text, minutes", [("+05:30", 330), ("-0800", -480), ("+02", 120), ("05:30", None), ("+15:00", None), ("+01:75", None), ("", None)])
def test_offset(text, minutes):
    assert fields.offset(text) == minutes


def test_position():
    dms = [(10, 1), (30, 1), (0, 1)]
    at = lambda a, b: fields.position({"GPSLatitude": dms, "GPSLongitude": dms, "GPSLatitudeRef": a, "GPSLongitudeRef": b})
    assert at("N", "W") == (10.5, -10.5) and at("", None) == (10.5, 10.5) and at("X", "E") == (None, None)
    zero = [(0, 1)] * 3
    assert fields.position({"GPSLatitude": zero, "GPSLongitude": zero}) == (None, None)
    assert fields.position({"GPSLatitude": [(91, 1)], "GPSLongitude": dms}) == (None, None)


def test_walk_and_readers(spark, tmp_path):
    write_library(str(tmp_path / "lib"), 40)
    for name in (".hidden.jpg", ".git/x.jpg", "@eaDir/x.jpg", "_DSC1.JPG", "deep/a/b/c.jpg", "note.txt", "deep/x.cr3"):
        write(tmp_path / "lib", name, jpeg(usual()))
    os.symlink(tmp_path / "lib" / "_DSC1.JPG", tmp_path / "lib" / "link.jpg")
    os.symlink(tmp_path / "lib" / "deep", tmp_path / "lib" / "again")
    root = str(tmp_path / "lib")
    want = sorted(images.walk(root))
    assert len(want) == 43 and any(p.endswith("_DSC1.JPG") for p in want)
    assert [os.path.basename(p) for p in images.walk(root, [".cr3"])] == ["x.cr3"]
    for folders in (1, 2, 64):
        got = images.read_images(spark, root, folders=folders)
        assert sorted(r["path"] for r in got.select("path").collect()) == want
    images.register(spark)
    source = spark.read.format("imageheaders").option("slices", 3).option("folders", 2).load(root)
    assert source.rdd.getNumPartitions() > 6
    assert sorted(map(str, source.collect())) == sorted(map(str, got.collect()))
    assert got.filter("status = 'ok'").count() == 42
    assert images.read_images(spark, str(tmp_path / "none")).count() == 0
