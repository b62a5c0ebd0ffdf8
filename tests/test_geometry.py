import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import geometry as g
from quadrat.functions import rasters as r
from quadrat.functions import sequences as s
from quadrat.operators import kernels
from tests import goldens

SQUARE = [(0, 0), (0, 2), (2, 2), (2, 0)]
SPIKE = [(0, 0), (0, 2), (3, 3), (2, 0)]


def ring(points):
    return g.ring(*[(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_area_and_bounds(spark):
    assert value(spark, g.area(ring(SQUARE))) == 4
    assert tuple(value(spark, g.bounds(ring(SPIKE)))) == (0, 0, 3, 3)
    assert value(spark, g.length(ring(SQUARE))) == 8


def test_polis(spark):
    assert value(spark, g.polis(ring(SQUARE), ring(SPIKE))) == pytest.approx(0.20466690944067711, abs=1e-12)
    assert value(spark, g.polis(ring(SQUARE), ring(SQUARE))) == 0
    big = [(0, 0), (0, 2.5), (2.5, 2.5), (2.5, 0)]
    spike = [(0, 0), (0, 2.5), (3.5, 3.5), (2.5, 0)]
    assert value(spark, g.batch_polis(ring(big), ring(spike))) == pytest.approx(0.21010164, abs=1e-8)
    assert value(spark, g.batch_polis(ring(big[:2]), ring(spike))) == 0


def test_ring_accuracy(spark):
    far = [(0, 0), (0, 2), (30, 30), (2, 0)]
    assert value(spark, s.ring_accuracy(ring(SQUARE), ring(far))) == pytest.approx(0.8620689655172413)
    assert value(spark, s.ring_accuracy(ring(SQUARE), ring(SQUARE))) == 1


@pytest.mark.parametrize("points", [[(100, 100), (100, 204), (204, 204), (204, 100)], [(196, 92), (204, 220), (36, 220), (28, 140), (20, 44), (84, 20)]])
def test_sequence_round_trip(spark, points):
    tokens = F.slice(s.encode(ring(points), 60), 3, 58)
    assert [(p["x"], p["y"]) for p in value(spark, s.decode(tokens))] == points
    assert [(p["x"], p["y"]) for p in value(spark, s.decode_to_mark(tokens))] == points


def test_thinned_sequence(spark):
    points = [(k * 8 + 4, 4) for k in range(20)]
    tokens = value(spark, s.encode(ring(points), 13))
    assert tokens == [0, 0, 0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 784]


def test_densify_rounds_half_to_even(spark):
    points = value(spark, g.densify(ring([(0, 0), (5, 0), (5, 4)]), 2.0))
    assert len([p for p in points if p["y"] == 0 and p["x"] < 5]) == 3  # the last one closes the line


def test_clip_and_canonical(spark):
    assert value(spark, g.area(g.clip(ring(SQUARE), 1, 1, 5, 5))) == 1
    assert value(spark, g.clip(ring(SQUARE), 3, 3, 5, 5)) == []
    a = value(spark, g.canonical(ring(SQUARE)))
    assert a == value(spark, g.canonical(ring([(2, 0), (2, 2), (0, 2), (0, 0)])))


def test_affine_inverse(spark):
    t = [F.lit(v) for v in (2.0, 0.5, 10.0, -0.25, -2.0, 90.0)]
    back = value(spark, g.affine_inverse(g.affine(ring(SPIKE), *t), *t))
    assert [(round(p["x"], 9), round(p["y"], 9)) for p in back] == SPIKE


def test_coerce_and_text(spark):
    assert value(spark, g.coerce_vertices(F.array().cast("array<double>")))["kind"] == "POINT"
    assert value(spark, g.coerce_vertices(F.array(*[F.lit(float(v)) for v in range(4)])))["kind"] == "LINE"
    assert value(spark, g.to_wkt(ring(SQUARE[:3]))) == "POLYGON ((0.0 0.0, 0.0 2.0, 2.0 2.0, 0.0 0.0))"
    with pytest.raises(ValueError, match="unknown kind"):
        g.handled("CURVE", ring(SQUARE))


def test_polygon_overlap_goldens():
    a = np.array([[2, 0], [2, 2], [0, 2], [0, 0]], float)
    assert kernels.ring_overlap(a, np.array([[1, 1], [4, 1], [4, 4], [1, 4]], float))[0] == pytest.approx(1 / 12)
    assert kernels.ring_overlap(a, np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float))[0] == pytest.approx(0.5)
    assert kernels.ring_overlap(a, np.zeros((0, 2))) == (0, 0, 4)


def test_overlap_against_pixels():
    rng = np.random.default_rng(3)
    for _ in range(20):
        angles = np.sort(rng.random((2, 9)) * 2 * math.pi, axis=1)
        a, b = (np.stack([30 + m * np.cos(t), 30 + m * np.sin(t)], 1) for t, m in zip(angles, rng.uniform(8, 28, (2, 9))))
        pixels = (kernels.fill([a * 10], 600, 600) & kernels.fill([b * 10], 600, 600)).sum() / 100
        assert kernels.shared_area(a, b) == pytest.approx(pixels, abs=3)


def test_contours():
    z = np.zeros((8, 8))
    z[2:5, 2:6] = 1
    (line,) = kernels.contours(z, 0.5)
    assert (line[0] == line[-1]).all()
    assert kernels.ring_area(line[:-1]) == pytest.approx(11.5)
    diagonal = np.pad(np.eye(2), 1)
    assert len(kernels.contours(diagonal, 0.5)) == 2


def test_polygonize_keeps_errors(spark):
    z = np.zeros((8, 8))
    z[2:6, 2:6] = 1
    df = spark.createDataFrame([(1, z.ravel().tolist()), (2, [1.0])], "image bigint, pixels array<double>")
    rows = kernels.polygonize(df, 8, 8, min_area=1).collect()
    assert {x["image"]: x["error"] is None for x in rows} == {1: True, 2: False}


def test_masks():
    m = kernels.masks_of([np.array([[2, 2], [10, 2], [10, 10], [2, 10]], float)], 20, 20)
    assert m["polygon"].sum() == 255 * 64
    assert m["boundary"][:3].sum() == 0
    # lines are 3 wide, discs too, direction lines 2 wide; level edges have the code 128, upright ones 0 or 255
    assert m["boundary"][5, 7:13].tolist() == [0, 255, 255, 255, 255, 0] and not m["boundary"][12].any()
    assert (m["vertex"] > 0).sum() == 4 * 4 and m["vertex"][1:3, 1:3].all() and m["vertex"][3:9].sum() == 0  # corner pixels are 0.71 and 1.58 away
    assert m["crossfield"][9, 6] == m["crossfield"][10, 6] == m["crossfield"][1, 6] == 128 and set(m["crossfield"][6, [1, 9, 10]].tolist()) <= {0, 255} and m["crossfield"][11].sum() == 0
    # distances are to what is drawn (here columns up to 11), sizes lie on that grown by 3
    assert m["distance"][5, 11] == 0 and m["distance"][5, 14] * 40 == pytest.approx(3) and m["distance"][19, 19] > 0
    assert m["size"][5, 14] == pytest.approx(64 / 400) and m["size"][5, 15] == 1


def test_masks_of_two_polygons_and_a_hole():
    outer, hole = np.array([[4, 4], [24, 4], [24, 24], [4, 24]], float), np.array([[9, 9], [19, 9], [19, 19], [9, 19]], float)
    m = kernels.masks_of([[outer, hole], np.array([[30, 30], [36, 30], [36, 36], [30, 36]], float), np.array([[90, 90], [99, 90], [99, 99]], float)], 40, 40)
    assert (m["polygon"] > 0).sum() == 400 - 100 + 36
    assert m["distance"][14, 14] == pytest.approx((3 + np.hypot(15, 15)) / 80)
    assert m["boundary"][14, 9] == 255 and m["size"][5, 5] == pytest.approx(300 / 1600) and m["size"][33, 33] == pytest.approx(36 / 1600)


def test_exact_distances_and_discs():
    rng = np.random.RandomState(3)
    for share in (0.02, 0.3, 0):
        mask = rng.rand(23, 37) < share
        at, ys, xs = np.argwhere(mask), *np.mgrid[:23, :37]
        wanted = np.sqrt(((ys[..., None] - at[:, 0]) ** 2 + (xs[..., None] - at[:, 1]) ** 2).min(2)) if len(at) else np.full((23, 37), np.inf)
        assert np.array_equal(kernels.distance_to(mask), wanted)
        assert np.array_equal(kernels.dilated(mask, 3), wanted <= 3)


def test_contour_errors_move_inner_points_too(spark):
    """Points inside the truth stay for the tangent angles, but move to its rings for the contour errors."""
    from quadrat.operators import contour_metrics as c

    truth, inner = np.array([[0, 0], [20, 0], [20, 20], [0, 20]], float), np.array([[2, 2], [18, 6], [18, 18], [2, 14]], float)
    assert c.tangent_angle_error([truth], [inner]) == 0
    assert c.tangent_angle_error([truth], [inner], on_rings=True) > 0.2
    shape = "array<struct<x:double,y:double>>"
    xy = lambda r: [tuple(map(float, p)) for p in r]
    half = np.array([[10, 0], [20, 0], [20, 20], [10, 20]], float)
    t = spark.createDataFrame([(1, 1, xy(truth[[0, 1]] * [0.5, 1]) + xy([[10, 20], [0, 20]])), (1, 2, xy(half))], f"image bigint, ref bigint, ref_ring {shape}")
    p = spark.createDataFrame([(1, 5, xy(truth)), (1, 6, xy(truth + 15)), (2, 7, xy(truth))], f"image bigint, target bigint, target_ring {shape}")
    got = {r["target"]: r["angle_error"] for r in c.contour_errors(t, p).collect()}
    assert set(got) == {5} and got[5] == pytest.approx(0, abs=1e-6)


def test_greedy_boxes(spark):
    b = [(1, k, *box, sc, 1) for k, (box, sc) in enumerate([((0, 0, 10, 10), 0.9), ((1, 1, 5, 5), 0.5), ((5, 5, 12, 12), 0.5)])]
    df = spark.createDataFrame([(i, k, *map(float, x), sc, lab) for i, k, *x, sc, lab in b], kernels.DETECTION)
    assert kernels.nms(df, 0.5, "IOU").count() == 3
    assert kernels.nms(df, 0.5, "IOS").count() == 1
    with pytest.raises(ValueError, match="unknown metric"):
        kernels.nms(df, 0.5, "DICE")


def test_pixel_iou(spark):
    rows = [([0, 0], [0, 0]), ([1, 0.5], [1, 1]), ([0.2, 0.8], [0, 0]), ([0.5, 0.5], [1, 1]), ([1, 1], [0, 0])]
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b]) for a, b in rows], "a array<double>, b array<double>")
    for threshold, mean in ((0.5, 0.3), (0.9, 0.5)):
        assert df.agg(F.avg(r.pixel_iou(F.col("a"), F.col("b"), threshold))).first()[0] == pytest.approx(mean)


def test_crossfield_round_trip(spark):
    u, v = r.cx(F.lit(0.8), F.lit(0.6)), r.cx(F.lit(-0.6), F.lit(0.8))
    c = r.crossfield_coefficients(u, v)
    assert value(spark, r.align_error(c["c0"], c["c2"], u)) == pytest.approx(0, abs=1e-12)
    d = r.crossfield_directions(c["c0"], c["c2"])
    again = r.crossfield_coefficients(d["u"], d["v"])
    assert value(spark, again["c0"]["re"]) == pytest.approx(value(spark, c["c0"]["re"]), abs=1e-9)


def test_matching_goldens(spark):
    """Ring goldens: what is matched, and the metrics of the two matches."""
    from quadrat.plans.pipelines import evaluate

    def load(rings):
        return [[{"x": x, "y": y} for x, y in ring] for ring in rings]

    refs = spark.createDataFrame([(1, k, v) for k, v in enumerate(load(goldens.REFERENCES))], f"image int, ref int, ref_ring {g.RING}")
    targets = spark.createDataFrame([(1, k, v) for k, v in enumerate(load(goldens.TARGETS))], f"image int, target int, target_ring {g.RING}")
    e = evaluate(refs, targets)
    rows = sorted(e["matches"].collect(), key=lambda x: -x["iou"])
    expected = [(0.8051144144, 54.7682505201, 68.0254253812, 0.5665716070, 1.0261994989, 1.1838713742), (0.7500752059, 958.5448025064, 1277.9315927335, 1.7580352387, 5.0103238459, 10.6582688968)]
    for row, want in zip(rows, expected, strict=True):
        assert [row[c] for c in ("iou", "inter", "uni", "polis", "hausdorff", "frechet")] == pytest.approx(list(want), abs=1e-9)
    assert e["unmatched_refs"].count() == 3
    assert e["unmatched_targets"].count() == 0
    accuracy = [x["a"] for x in e["matches"].orderBy(F.desc("iou")).select(s.ring_accuracy(F.col("ref_ring"), F.col("target_ring"), 10000, 300).alias("a")).collect()]
    assert accuracy == pytest.approx([0.4283856771, 0.0135027005], abs=1e-9)


def test_tangent_angles(spark):
    from quadrat.operators.contour_metrics import tangent_angle_error, with_tangent_angle_error

    square = np.array(SQUARE, float) * 10
    assert tangent_angle_error([square], [square]) == pytest.approx(0, abs=1e-7)
    assert tangent_angle_error([square], []) is None
    refs, targets = ([np.array(r) for r in rings] for rings in (goldens.REFERENCES, goldens.TARGETS))
    best = [max(refs, key=lambda r: kernels.ring_overlap(r, t)[0]) for t in targets]
    errors = sorted(tangent_angle_error([b], [t]) for b, t in zip(best, targets))
    assert errors == pytest.approx([0.1861112761, 0.5430984566], abs=1e-9)
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in square.tolist()], None)], f"a {g.RING}, b {g.RING}")
    assert with_tangent_angle_error(df, "a", "a").first()["angle_error"] == pytest.approx(0, abs=1e-7)
    assert with_tangent_angle_error(df, "a", "b").first()["angle_error"] is None


def test_rings_in_arrow_columns():
    rings = [np.array([[0, 0], [1, 0], [1, 1]], float), None, np.zeros((0, 2)), np.array([[5, 5], [6, 5]], float)]
    column = kernels.column_of(rings)
    for part, wanted in ((column, rings), (column.slice(1, 3), rings[1:]), (column.slice(4), [])):
        got = kernels.rings_of(part)
        assert [r.tolist() for r in got] == [[] if r is None else r.tolist() for r in wanted]
    assert column.to_pylist()[1] is None and column.to_pylist()[2] == []


def test_first_crossing_is_the_first_in_order():
    rng = np.random.RandomState(5)
    for n in (4, 5, 9, 30):
        ring = rng.rand(n, 2)
        found = kernels.first_crossing(ring, at_once=37)
        wanted = None
        for i in range(n):
            for j in range(i + 2, n if i else n - 1):
                a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
                t, u = np.linalg.solve(np.stack([b - a, c - d], 1), c - a)
                if wanted is None and 0 < t < 1 and 0 < u < 1:
                    wanted = (i, j)
        assert (found and found[:2]) == wanted


def test_distances_of_many_pairs_agree_with_the_columns(spark):
    rng = np.random.RandomState(6)
    xy = lambda n: [tuple(map(float, p)) for p in rng.randint(0, 30, (n, 2))]
    rows = [(k, xy(rng.randint(3, 7)), xy(rng.randint(3, 7))) for k in range(40)] + [(90, None, xy(3)), (91, [], xy(3)), (92, [(1.0, 2.0)] * 4, xy(3))]
    df = spark.createDataFrame(rows, "id int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    for kind, column in (("hausdorff", g.hausdorff), ("frechet", g.frechet)):
        got = kernels.with_ring_distance(df, "a", "b", kind).withColumn("same", column(F.col("a"), F.col("b"))).collect()
        assert all(r["distance"] == pytest.approx(r["same"]) for r in got if r["a"])
        assert [r["distance"] for r in got if not r["a"]] == [None, None]


def test_overlaps_of_many_pairs_agree_with_single_ones():
    rng = np.random.RandomState(7)
    some = lambda n, k: rng.rand(n, 2) if k % 2 else rng.randint(0, 6, (n, 2)).astype(float)
    left, right = ([some(n, k) for k, n in enumerate(rng.randint(0, 10, 60))] for _ in range(2))
    large = np.stack([np.cos(t := np.linspace(0, 6, 260)), np.sin(t)], 1) * rng.uniform(0.9, 1.1, (260, 1))
    left, right = [*left, large, np.array([[0, 0], [np.nan, 1], [1, 1]])], [*right, some(5, 1), some(5, 1)]
    wanted = np.array([kernels.ring_overlap(a, b) for a, b in zip(left, right)])
    for bounds in ({}, {"vertices": 50, "pairs": 7, "triangles": 10}):
        np.testing.assert_allclose(kernels.ring_overlaps(left, right, **bounds), wanted, rtol=1e-12, atol=1e-12)
    assert kernels.ring_overlaps([], []).shape == (0, 3)


def test_overlaps_of_many_pairs_are_computed_together(monkeypatch):
    """A batch of crossed rings takes a few calls of the kernels and not some per pair."""
    calls = []
    for name in ("_clip_triangles", "first_crossing"):
        kernel = getattr(kernels, name)
        monkeypatch.setattr(kernels, name, lambda *a, kernel=kernel, **k: calls.append(kernel) or kernel(*a, **k))
    run = kernels.with_polygon_iou(SimpleNamespace(schema=T.StructType([]), mapInArrow=lambda run, schema: run), "a", "b")
    bows = [np.array([[k, 0], [k + 2, 3], [k + 2, 0], [k, 3]], float) for k in range(500)]
    squares = [r[[0, 2, 1, 3]] for r in bows]
    (out,) = run(iter([pa.RecordBatch.from_arrays([kernels.column_of(bows), kernels.column_of(squares)], ["a", "b"])]))
    assert [out.column(c).to_pylist() for c in ("iou", "inter", "uni")] == [pytest.approx([v] * 500) for v in (0.5, 3, 12)]
    assert len(calls) < 20


def test_crossed_rings_of_one_file_meet_all_cores(spark, tmp_path):
    from quadrat.plans.sources import crossed_iou

    spark.range(200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = crossed_iou(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in rows) == list(range(200)) and {r["iou"] for r in rows} == {0.5}
    assert len({r["task"] for r in rows}) == 4
