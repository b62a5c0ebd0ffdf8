import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import rasters as r
from quadrat.functions import sequences as s
from quadrat.operators import active, kernels, skeletons
from quadrat.plans import pipelines
from quadrat.sources import images


def square(size, a, b):
    z = np.zeros((size, size))
    z[a:b, a:b] = 1
    return z


def test_descent_keeps_a_square():
    z = square(32, 8, 24)
    c = np.zeros((4, 32, 32))
    c[0], c[2] = -1, 0  # u = 1, v = i: c0 = u^2 v^2 = -1, c2 = -(u^2 + v^2) = 0
    field = np.stack([c[0] + 1j * c[1], c[2] + 1j * c[3]])
    (line,) = kernels._closed_contours(z, 0.5)
    before = active.alignment(np.roll(line[:-1], -1, 0) - line[:-1], *active.sample(field, line[:-1])[0]).mean()
    ring = active.descend(line[:-1], z, field, steps=100)
    after = active.alignment(np.roll(ring, -1, 0) - ring, *active.sample(field, ring)[0]).mean()
    assert after <= before + 1e-6
    assert kernels.ring_area(ring) == pytest.approx(256, rel=0.06)


def test_active_contours(spark):
    z = square(24, 6, 18)
    rows = [(1, z.ravel().tolist()), (2, [1.0]), (3, np.zeros(576).tolist())]
    got = active.active_contours(spark.createDataFrame(rows, "image bigint, pixels array<double>"), 24, 24, steps=50).collect()
    assert {x["image"] for x in got if x["error"] is None} == {1}
    assert {x["image"] for x in got if x["error"]} == {2}
    assert [x["area"] for x in got if x["error"] is None] == [pytest.approx(144, rel=0.1)]


def test_pieces_between_corners():
    ring = np.array([[0, 0], [1, 0], [2, 0], [2, 1], [2, 2], [1, 2], [0, 2], [0, 1]], float)
    assert len(active.simplify_between(ring, active.corner_mask(ring, None), 0.1)) == 4


def test_skeletons(spark):
    z = np.zeros((15, 15))
    z[6:9, 2:13] = 1
    rows = skeletons.skeleton_paths(spark.createDataFrame([(1, z.ravel().tolist()), (2, np.zeros(225).tolist())], "image bigint, pixels array<double>"), 15, 15)
    got = rows.collect()
    assert {x["image"] for x in got} == {1}
    assert all(x["y"] == 7 for x in got) and len({x["path"] for x in got}) == 1
    packed = skeletons.to_csr(rows)
    assert packed.first()["indptr"] == [0, len(got)]
    back = skeletons.from_csr(packed).collect()
    assert sorted((x["path"], x["ord"], x["node"]) for x in back) == sorted((x["path"], x["ord"], x["node"]) for x in got)


def test_junctions_are_path_ends():
    z = np.zeros((9, 9), bool)
    z[4, 1:8] = z[1:8, 4] = True
    nodes, degree, paths = skeletons.trace(z)
    assert sum(len(p) - 1 for p in paths) == sum(degree) // 2


def test_repair_and_tokens(spark):
    bow = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (2, 2), (2, 0), (0, 2))]
    df = spark.createDataFrame([(1, bow), (2, None), (3, bow[:2])], f"id int, ring {g.RING}")
    parts = kernels.repair(df, "ring").select("id", "part", g.area(F.col("ring")).alias("a")).collect()
    assert sorted(map(tuple, parts)) == [(1, 0, 1.0), (1, 1, 1.0)]
    ring = g.ring(*[(F.lit(x), F.lit(y)) for x, y in ((100, 100), (100, 204), (204, 204), (204, 100))])
    seq = spark.range(1).select(F.slice(s.encode(ring, 60), 3, 58).alias("tokens"), *[F.lit(v).alias(n) for n, v in (("scale_w", 2.0), ("scale_h", 2.0), ("min_col", 10.0), ("min_row", 0.0))])
    assert pipelines.polygonize_tokens(seq, min_area=2704.0, tolerance=0.5).select(g.area(F.col("ring"))).first()[0] == 52 * 52
    assert pipelines.polygonize_tokens(seq, min_area=2704.5).count() == 0


def test_small_functions(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    pixels = F.array(*[F.lit(float(k)) for k in range(6)])
    assert v(r.flipped(pixels, 3)) == [2, 1, 0, 5, 4, 3]
    assert v(r.normalize(pixels, F.lit(1.0), F.lit(2.0)))[3] == 1
    assert v(r.denormalize(r.normalize(pixels, F.lit(1.0), F.lit(2.0)), F.lit(1.0), F.lit(2.0)))[5] == 5
    some = F.array(F.lit(0.0), F.lit(1.0))
    assert [v(r.valid_crop(m, F.lit(f), z)) for m, f, z in ((some, 0.5, None), (some, 0.0, None), (some, 1.0, None), (F.array(F.lit(0.0)), 0.0, None), (some, 0.5, some), (some, 0.5, F.array(F.lit(0.1))))] == [True, False, False, True, False, True]
    assert v(r.pixel_weight(F.lit(0.5), F.lit(0.1), F.lit(0.25), 30, 20)) == pytest.approx((2 + 50 * math.exp(-25 / 100)) * (1 + 1 / (math.sqrt(600) / 2 * 0.25)))
    t = [F.lit(x) for x in (2.0, 0.0, 100.0, 0.0, -2.0, 200.0)]
    box = F.struct(*[F.lit(x).alias(n) for n, x in (("x1", 103.0), ("y1", 150.0), ("x2", 121.0), ("y2", 190.0))])
    assert tuple(v(g.image_box(box, *t))) == (1, 5, 9, 20)
    assert v(r.clear_frame(F.array_repeat(F.lit(1.0), 64), 8, 8)).count(1.0) == 4
    assert v(r.focal_tversky(pixels, pixels)) is not None
    assert v(r.cx_abs(r.cx_sqrt(r.cx(F.lit(3.0), F.lit(4.0))))) == pytest.approx(math.sqrt(5))


def test_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert images.file_hashes(spark, str(tmp_path)).first()["sha1"] == hashlib.sha1(b"abc").hexdigest()


def test_outlines_descend_together_as_alone():
    rng = np.random.default_rng(3)
    pixels = rng.normal(size=(5, 8, 8))
    fields = np.exp(1j * rng.normal(size=(5, 2, 8, 8)))
    lines = [(k, line[:-1]) for k in range(5) for line in kernels._closed_contours(pixels[k], 0.0)]
    moved = active.descend_all([line for _, line in lines], [k for k, _ in lines], pixels, fields, 0.0, 40)
    for (k, line), ring in zip(lines, moved):
        assert np.allclose(ring, active.descend(line, pixels[k], fields[k], 0.0, 40))


def test_contour_query_runs_all_steps_with_a_frame_field(spark, monkeypatch):
    from quadrat.plans import pixels

    ramp = [float(c + 2 * q) - 10.5 for q in range(8) for c in range(8)]
    source = spark.createDataFrame([(1, 0, ramp)], "image bigint, label int, pixels array<double>")
    monkeypatch.setattr(pixels, "rasters", lambda *_: source)
    given = []
    whole = active.active_contours
    monkeypatch.setattr(active, "active_contours", lambda df, *a, **k: given.append((df, k)) or whole(df, *a, **k))
    assert all(x["error"] is None for x in pixels.active_contours(spark, "").collect())
    assert given[0][1].get("steps", 500) == 500
    field = np.array(given[0][0].first()["field"]).reshape(4, 8, 8)[:, 3, 3]
    assert field[0] + 1j * field[1] == pytest.approx(-np.exp(4j * np.arctan2(2, 1)))
    assert np.abs(field[2:]).max() < 1e-9
