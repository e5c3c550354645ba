"""The report, its sinks, the command line and the stream."""

import html.parser
import json
import re
from datetime import datetime

import pytest

from shutterlake import cli
from shutterlake.operators.frames import Options
from shutterlake.plans.report import report
from shutterlake.sinks import page, text
from shutterlake.streaming import counters as stream

from .images import jpeg, usual, write, write_library
from .test_operators import bronze

SECTIONS = ["meta", "scan", "span", "gear", "focal", "aperture", "shutter", "iso", "time_of_day", "calendar", "locations", "absences", "habits", "filters"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [{"focal": [24.0, 35.0, 70.0, 30.0][i % 4], "lens": "Zöom <b>", "lens_min": 24.0, "lens_max": 105.0, "latitude": 51.507351, "longitude": -0.127758, "flash": False, "taken": datetime(2022 + i % 2, 1 + i % 12, 3, i % 24)} for i in range(80)]
    rows += [{"status": "unsupported", "container": "cr3"}, {"status": "no-exif", "container": "png"}, {"status": "unreadable"}]
    return report(bronze(spark, rows), meta={"version": "x"})


def test_report(found):
    assert list(found) == SECTIONS
    assert found["scan"]["files_seen"] == 83 and found["scan"]["photos"] == 80
    assert found["scan"]["unsupported_formats"] == {"cr3": 1} and found["scan"]["no_exif_formats"] == {"png": 1}
    assert found["span"]["years"] == [2022, 2023] and found["calendar"]["days_shot"] == 12
    assert found["locations"]["clusters"][0]["label"] == "51.51 N, 0.13 W"
    assert found["time_of_day"]["twilight"]["basis"] == "OffsetTime tag"
    assert found["absences"]["unreached_focal_range"][0]["reached"] == 70
    assert found["focal"]["zooms"][0]["unused_long"] == {"declared": 105.0, "reached": 70.0}
    dumped = json.dumps(found)
    assert "51.507" not in dumped and "0.1277" not in dumped


def test_empty_report(spark):
    for rows in ([], [{"status": "no-exif"}]):
        empty = report(bronze(spark, rows))
        assert list(empty) == SECTIONS and not empty["focal"]["available"] and empty["habits"] == []
        assert page.render(empty).endswith("</html>\n") and "frames read      0" in text.summary(empty)
    bare = report(bronze(spark, [{k: None for k in ("camera", "lens", "focal", "fnumber", "exposure", "iso", "taken", "tz_minutes")}] * 3), Options(gps="off"))
    assert bare["gear"]["cameras"][0]["name"] == "Unrecorded body" and bare["locations"]["mode"] == "off"
    page.render(bare)


class _Tags(html.parser.HTMLParser):
    open = ()

    def handle_starttag(self, tag, attrs):
        assert tag not in ("script", "link", "img", "iframe")
        assert not any(k in ("src", "href") or k.startswith("on") for k, _ in attrs)
        if tag not in ("meta", "br", "line", "rect"):
            self.open = (*self.open, tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag not in ("rect", "line"):
            assert self.open[-1] == tag
            self.open = self.open[:-1]


def test_page(found):
    out = page.render(found)
    assert out.isascii() and "http" not in out.replace("http-equiv", "") and "Zöom" not in out and "Z&#246;om &lt;b&gt;" in out
    parser = _Tags()
    parser.feed(out)
    assert parser.open == ()
    assert out.count("<svg") == out.count("</svg>") >= 8
    assert [m for m in re.findall(r'section id="(\w+)"', out)] == ["gear", "focal", "exposure", "iso", "time", "calendar", "places", "absences", "habits"]


def test_text_helpers():
    assert (text.percent(0.004), text.percent(0.5), text.some(1, "frame"), text.some(1200, "frame"), text.short(8.0), text.day("2024-06-01 10:00:00"), text.size(1536)) == ("<1%", "50%", "1 frame", "1,200 frames", "8", "1 Jun 2024", "1.5 KB")
    assert page.steps(0) == [0] and page.steps(7)[-1] >= 7 and page.steps(1234)[-1] >= 1234 and len(page.steps(1234)) <= 6


def test_command_line(spark, tmp_path, capsys):
    lib = tmp_path / "lib"
    write_library(str(lib), 8)
    write(lib, "raw.cr3", b"x")
    run = lambda *a: cli.main(["scan", str(lib), "--quiet", *map(str, a)])
    out, js = tmp_path / "new" / "r.html", tmp_path / "new" / "r.json"
    assert run("-o", out, "--json", js) == 0
    data = json.loads(js.read_text())
    assert data["scan"]["photos"] == 8 and data["scan"]["unsupported"] == 1 and out.read_text().startswith("<!DOCTYPE html>")
    assert run("--json") == 0
    assert json.loads(capsys.readouterr().out)["scan"]["photos"] == 8
    assert run("--json", js, "--since", "2021-01-01", "--until", "2021-12-31", "--no-gps") == 0
    data = json.loads(js.read_text())
    assert 0 < data["scan"]["photos"] < 8 and data["locations"]["mode"] == "off" and data["filters"]["since"] == "2021-01-01"
    assert run("--json", js, "--precise-gps") == 0
    assert "33.8587" in js.read_text() or "33.8588" in js.read_text()
    assert run("--precise-gps", "--no-gps") == 2 and run("--since", "2024-01-02", "--until", "2024-01-01") == 2
    assert cli.main(["scan", str(tmp_path / "missing")]) == 2
    (tmp_path / "empty").mkdir()
    assert cli.main(["scan", str(tmp_path / "empty")]) == 1
    assert cli.main([]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["scan", str(lib), "--since", "soon"])
    assert e.value.code == 2


def test_stream(spark, tmp_path):
    landing = str(tmp_path / "landing")
    first, second = bronze(spark, [{}] * 3 + [{"status": "no-exif"}]), bronze(spark, [{"focal": 50.0, "taken": datetime(2024, 6, 21, 9, 5)}] * 2)
    first.write.parquet(landing)
    go = lambda df, name: stream.keep(df, name, str(tmp_path / name)).awaitTermination()
    landed = stream.landed(spark, landing)
    go(stream.value_counts(landed, "focal"), "focals")
    assert {r["focal"]: r["n"] for r in spark.table("focals").collect()} == {23.0: 3}
    second.write.mode("append").parquet(landing)
    go(stream.value_counts(stream.landed(spark, landing), "focal"), "focals")
    assert {r["focal"]: r["n"] for r in spark.table("focals").collect()} == {23.0: 3, 50.0: 2}
    go(stream.scan_totals(stream.landed(spark, landing)), "totals")
    assert spark.table("totals").first()["files_seen"] == 6
    go(stream.frames_by_window(stream.landed(spark, landing)), "windows")
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [2, 3]


def test_library_page_end_to_end(spark, tmp_path):
    from shutterlake.sources.images import read_images

    for i in range(70):
        write(tmp_path, f"{i}.jpg", jpeg(usual(i)))
    out = report(read_images(spark, str(tmp_path)))
    assert out["scan"]["photos"] == 70 and out["focal"]["distinct"] == 4 and out["locations"]["total_clusters"] == 1


def test_progress_is_told_while_a_job_runs(spark):
    import time

    def slow(batches):
        for b in batches:
            time.sleep(0.8)
            yield b

    said = []
    with cli.Progress(spark, said.append, every=0.1):
        spark.range(6).repartition(6).mapInArrow(slow, "id bigint").count()
    assert said and all(re.fullmatch(r"  reading: \d+ of \d+ parts", x) for x in said) and len(set(said)) == len(said)
