import pytest
from pyspark.sql import functions as F

from quadrat.functions import boxes
from quadrat.operators import lines, logs, manifests, matching, tiles
from quadrat.plans import pipelines


def objects(spark, rows, name):
    return spark.createDataFrame([(i, k, [float(v) for v in b]) for i, k, b in rows], f"image int, {name} int, b array<double>").select("image", name, boxes.box(*[F.col("b")[k] for k in range(4)]).alias(f"{name}_box"))


def test_first_target_keeps_a_contended_reference(spark):
    refs = objects(spark, [(1, 1, (0, 0, 10, 10)), (1, 2, (100, 0, 110, 10)), (2, 1, (0, 0, 1, 1))], "ref")
    targets = objects(spark, [(1, 1, (0, 0, 10, 8)), (1, 2, (0, 0, 10, 10)), (1, 3, (50, 50, 60, 60))], "target")
    for cell in (None, 4.0):
        m = matching.match_boxes(refs, targets, 0.5, cell)
        assert [(r["image"], r["ref"], r["target"]) for r in m.collect()] == [(1, 1, 1)]
    assert matching.unmatched(targets, m, "target").count() == 2
    assert matching.unmatched(refs, m, "ref").count() == 2
    assert matching.matched(refs, m, "ref").count() == 1


def test_ties_go_to_the_lowest_reference_and_touching_counts(spark):
    refs = objects(spark, [(1, 2, (0, 0, 2, 2)), (1, 1, (0, 0, 2, 2))], "ref")
    targets = objects(spark, [(1, 1, (0, 0, 2, 2)), (1, 2, (2, 2, 4, 4))], "target")
    pairs = matching.candidates(refs, targets)
    assert pairs.count() == 4
    got = matching.first_wins(pairs.withColumn("s", boxes.iou(F.col("ref_box"), F.col("target_box"))), "s")
    assert [(r["ref"], r["target"]) for r in got.collect()] == [(1, 1)]


def test_small_scores_with_a_threshold(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 2, 9.0)], "image int, ref int, target int, d double")
    assert [r["ref"] for r in matching.first_wins(pairs, "d", False, 5.0).collect()] == [2]
    assert [r["ref"] for r in matching.first_wins(pairs, "d", False, 5.0, strict=True).collect()] == [1]


def test_empty_sides(spark):
    refs, targets = objects(spark, [], "ref"), objects(spark, [(1, 1, (0, 0, 1, 1))], "target")
    m = matching.match_boxes(refs, targets)
    assert m.count() == 0
    assert matching.unmatched(targets, m, "target").count() == 1


def test_candidates_are_an_equality_join(spark):
    refs, targets = objects(spark, [(1, 1, (0, 0, 1, 1))], "ref"), objects(spark, [(1, 1, (0, 0, 1, 1))], "target")
    plan = matching.match_boxes(refs, targets)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_box_goldens(spark):
    rows = [(0, 0, 10, 10), (5, 5, 20, 20), (50, 50, 150, 150), (100, 100, 200, 200)]
    df = objects(spark, [(1, k, b) for k, b in enumerate(rows)], "ref")
    got = df.orderBy("ref").select(boxes.crop(F.col("ref_box"), F.lit(100), F.lit(100)).alias("b")).collect()
    assert [tuple(r["b"]) for r in got] == [(0, 0, 10, 10), (5, 5, 20, 20), (50, 50, 100, 100), (100, 100, 100, 100)]
    with pytest.raises(ValueError, match="no conversion"):
        boxes.convert_box(F.lit(None), "xyxy", "polar")


def test_tile_merge_golden(spark):
    """Eight detections of four tiles become six boxes, best first."""
    given = [
        (0, 0, [(10, 10, 50, 50, 0.9), (110, 110, 150, 150, 0.5)]),
        (0, 100, [(120, 10, 160, 50, 0.5), (10, 110, 50, 150, 0.9)]),
        (100, 0, [(10, 120, 50, 160, 0.5), (110, 10, 150, 50, 0.9)]),
        (100, 100, [(120, 120, 160, 160, 0.5), (10, 10, 50, 50, 0.9)]),
    ]
    rows, n = [], 0
    for r0, c0, found in given:
        for *b, score in found:
            rows.append((1, n, *map(float, b), score, 1, r0, c0, 300, 300))
            n += 1
    df = spark.createDataFrame(rows, "image bigint, det bigint, x1 double, y1 double, x2 double, y2 double, score double, label int, row0 int, col0 int, height int, width int")
    got = [tuple(r) for r in tiles.merge_detections(df).orderBy("det").select("x1", "y1", "x2", "y2", "score").collect()]
    assert got == [(10, 10, 50, 50, 0.9), (10, 210, 50, 250, 0.9), (210, 10, 250, 50, 0.9), (110, 110, 160, 150, 0.9), (110, 120, 150, 160, 0.5), (220, 220, 260, 260, 0.5)]
    with pytest.raises(ValueError, match="unknown method"):
        tiles.merge_detections(df, "mean")


def test_vertex_errors_golden(spark):
    gt = [(0, 0), (0, 2), (2, 2), (2, 0)]
    pred = [(0.1, 0.1), (0.1, 2.1), (30, 30), (2.4, 2.4), (2.1, 0.1)]
    rings = [[{"x": float(x), "y": float(y)} for x, y in r] for r in (gt, pred)]
    df = spark.createDataFrame([(1, 0, *rings)], "image int, pair int, ref_ring array<struct<x:double,y:double>>, target_ring array<struct<x:double,y:double>>")
    got = matching.vertex_errors(df).orderBy("gt_ord").collect()
    assert [r["distance"] for r in got] == pytest.approx([0.1414213562, 0.1414213562, 0.5656854249, 0.1414213562])


def test_merge_keeps_nulls_and_columns(spark):
    a = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("c", 3, 3)], "k string, v int, w int")
    b = spark.createDataFrame([("a", 9, None, 1), ("b", None, 8, 1)], "k string, v int, w int, x int")
    assert sorted(map(tuple, manifests.merge_manifests(a, b, "k").collect())) == [("a", 9, 1), ("b", 2, 8), ("c", 3, 3)]
    assert [r["k"] for r in manifests.same_keys(a, b, "k").collect()] == ["c"]


def test_cycle_of_empty_side(spark):
    a = manifests.numbered(spark.range(5).withColumnRenamed("id", "a"), ["a"])
    assert manifests.cycle_zip(a, a.limit(0).withColumnRenamed("a", "b")).count() == 0
    assert [r["pos"] for r in a.orderBy("a").collect()] == [0, 1, 2, 3, 4]


def test_closed_line_pieces(spark):
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate([0, 1, 0, 1, 0])], "id int, ord int, is_corner int")
    assert [r["piece"] for r in lines.subpaths(df, ["id"]).orderBy("ord").collect()] == [2, 1, 1, 2, 2]


def test_zero_denominators(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0)], "k string, i double, u double")
    assert logs.micro_iou(df, ["k"], "i", "u").first()["micro_iou"] is None
    c = logs.confusion(spark.createDataFrame([(1, False, False)], "k int, p boolean, t boolean"), ["k"], F.col("p"), F.col("t")).first()
    assert (c["accuracy"], c["precision"], c["recall"], c["f1"], c["iou"]) == (1, 0, 0, 0, 0)


def test_average_precision_without_hits(spark):
    scored = spark.createDataFrame([("a", 0.9, True, 1), ("a", 0.8, False, 2), ("b", 0.5, False, 3)], "k string, score double, hit boolean, o int")
    totals = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "k string, n_truth int")
    got = {r["k"]: r["ap"] for r in logs.average_precision(scored, totals, ["k"], "score", "hit", "o").collect()}
    assert got == {"a": pytest.approx(1.0), "b": 0.0, "c": 0.0}


def test_prediction_keeps_going(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 2.0, 3.0, 4.0]), (2, 0, 0, [9.0, 0.0, 0.0, 0.0])], "image bigint, row0 int, col0 int, pixels array<double>")

    def scorer(a):
        if (a == 9).any():
            raise ValueError("nine")
        return a / 10

    got = {r["image"]: (r["pixels"], r["error"]) for r in pipelines.predict(df.coalesce(1), scorer, 2, 2).collect()}
    assert got == {1: ([0.1, 0.2, 0.3, 0.4], None), 2: (None, "ValueError: nine")}


def test_masks_from_features(spark):
    extents = spark.createDataFrame([(1, (0.0, 0.0, 20.0, 20.0), 1.0, 0.0, 0.0, 0.0, -1.0, 20.0)], "image bigint, extent_box struct<x1:double,y1:double,x2:double,y2:double>, ta double, tb double, tc double, td double, te double, tf double")
    square = [{"x": float(x), "y": float(y)} for x, y in ((2, 2), (10, 2), (10, 10), (2, 10))]
    far = [{"x": p["x"] + 500, "y": p["y"]} for p in square]
    features = spark.createDataFrame([(1, square), (2, far)], "feature bigint, ring array<struct<x:double,y:double>>")
    masks = pipelines.build_masks(extents, features, 20, 20, 16.0)
    assert {r["mask"]: sum(r["pixels"]) for r in masks.where("mask = 'polygon'").collect()} == {"polygon": 255.0 * 64}
    manifest = pipelines.mask_manifest(spark.createDataFrame([(1,), (2,)], "image bigint"), masks, "/out").orderBy("image").collect()
    assert manifest[0]["polygon_mask"] == "/out/polygon_masks/1.png" and manifest[1]["polygon_mask"] is None


def test_running_sums_of_hot_and_null_keys(spark):
    """Blocks of a few rows give the sums of one window; ties and missing values too."""
    rows = [(None if k % 7 == 0 else "hot" if k % 3 else f"k{k % 5}", (k * 37) % 101, None if k % 11 == 0 else float(k)) for k in range(300)]
    rows = [(key, step * 1000 + i, v) for i, (key, step, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "key string, step bigint, value double")
    got = {r["step"]: (r["_place"], r["total"]) for r in logs.running_sums(df, ["key"], ["step"], {"total": F.col("value")}, block=13).collect()}
    wanted, seen = {}, {}
    for key, step, v in sorted(rows, key=lambda r: r[1]):
        n, total = seen.get(key, (0, 0.0))
        seen[key] = wanted[step] = (n + 1, total + (v or 0.0))
    assert got == wanted
    assert logs.running_sums(df.limit(0), ["key"], ["step"], {"total": F.col("value")}).count() == 0
