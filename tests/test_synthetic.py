"""The synthetic library: the same each time, of sound values, and the same again from its files."""

from shutterlake.sources import synthetic
from shutterlake.sources.images import read_images


def test_rows_are_the_same_in_any_order(spark):
    a = synthetic.frames(spark, 500, partitions=1)
    b = synthetic.frames(spark, 500, partitions=7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert sorted(map(str, synthetic.frames(spark, 500, seed=1).collect())) != sorted(map(str, a.collect()))
    for r in a.collect():
        assert r["lens_min"] <= r["focal"] <= r["lens_max"] and r["fnumber"] >= 1.0 and 2021 <= r["taken"].year <= 2026 and r["latitude"] is None
    assert a.select("camera").distinct().count() == 3 and a.select("lens").distinct().count() == 6


def test_files_hold_the_rows(spark, tmp_path):
    rows = synthetic.frames(spark, 60)
    assert synthetic.write_library(rows, str(tmp_path)).filter("size > 200").count() == 60
    got = {r["path"][len(str(tmp_path)) :]: r for r in read_images(spark, str(tmp_path)).collect()}
    for r in rows.collect():
        g = got[r["path"]]
        assert g["status"] == "ok"
        for name in ("camera", "lens", "lens_min", "lens_max", "focal", "iso", "taken", "flash", "orientation"):
            assert g[name] == r[name], name
        assert abs(g["fnumber"] - r["fnumber"]) < 1e-6 and abs(g["exposure"] - r["exposure"]) < 1e-6
