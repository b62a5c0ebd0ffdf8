"""Raster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import rasters as r
from quadrat.operators import active, kernels, logs, skeletons, tiles
from quadrat.plans.derived import PIXELS_SQL, rasters, rings, rings_sql
from quadrat.session import table

_THRESHOLDS = (-0.1, 0.0, 0.1, 0.25)


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster as prediction (in 0..1) and its mirror image's mask as truth."""
    p = rasters(spark, sf_dir)
    truth = F.transform(F.reverse("pixels"), lambda v: (v > 0).cast("double"))
    return p.withColumn("pred", F.transform("pixels", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + 0.5)))).withColumn("truth", truth)


def pixel_iou_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean IoU of rasters and their mirror images per label and threshold."""
    t = F.explode(F.array(*[F.lit(v) for v in _THRESHOLDS])).alias("threshold")
    p = rasters(spark, sf_dir).select("label", "pixels", F.reverse("pixels").alias("mirror"), t)
    return p.groupBy("label", "threshold").agg(F.round(F.avg(r.pixel_iou(F.col("pixels"), F.col("mirror"), F.col("threshold"))), 6).alias("iou"))


def dice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice loss per raster."""
    return _pair(spark, sf_dir).select("image", F.round(r.dice_loss(F.col("pred"), F.col("truth")), 6).alias("dice"))


def tversky_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tversky index and its focal loss per raster."""
    p, t = F.col("pred"), F.col("truth")
    return _pair(spark, sf_dir).select("image", F.round(r.tversky(p, t), 6).alias("tversky"), F.round(r.focal_tversky(p, t), 6).alias("focal"))


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy of the first ten numbers against the label, plain and smoothed."""
    logits = F.slice("pixels", 1, 10)
    plain, smooth = r.cross_entropy(logits, F.col("label")), r.cross_entropy(logits, F.col("label"), 0.1)
    return rasters(spark, sf_dir).select("image", F.round(plain, 6).alias("ce"), F.round(smooth, 6).alias("smooth_ce"))


def band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation and class frequency per label and row of the rasters."""
    p = rasters(spark, sf_dir).select("label", F.posexplode("pixels").alias("i", "v")).withColumn("band", F.floor(F.col("i") / 8).cast("bigint"))
    return logs.weight_histogram(p, ["label", "band"], "v").select("label", "band", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "std", "class_freq")])


def tile_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile origins of each listed image, 448 wide in steps of 224."""
    d = table(spark, sf_dir, "dsg_dataset").where("width is not null and height is not null").select("row_id", "width", "height")
    return tiles.tile_origins(d, 448, 224).select("row_id", F.col("tile_no").cast("bigint").alias("tile_no"), F.col("row0").cast("bigint").alias("row0"), F.col("col0").cast("bigint").alias("col0"))


def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters laid as overlapping tiles (three to an image, two rows apart), merged by weight."""
    p = rasters(spark, sf_dir).select("image", F.posexplode("pixels").alias("i", "v"))
    k = F.col("image") % 3
    p = p.select(F.floor(F.col("image") / 3).cast("bigint").alias("scene"), (F.floor(F.col("i") / 8) + k * 2).cast("bigint").alias("row"), (F.col("i") % 8).cast("bigint").alias("col"), "v", (1.0 + k).alias("w"))
    return tiles.merge_tiles(p, ["scene", "row", "col"], "v", "w").select("scene", "row", "col", F.round("v", 6).alias("v"))


def _exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select("image", F.posexplode(column).alias("i", name)).withColumn("i", F.col("i").cast("bigint")).withColumn(name, F.round(name, 6) + F.lit(0.0))


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude of the Laplacian per pixel."""
    return _exploded(rasters(spark, sf_dir).withColumn("l", r.laplacian(F.col("pixels"), 8, 8)), "l", "v")


def scharr_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal Scharr gradient per pixel."""
    return _exploded(rasters(spark, sf_dir).withColumn("l", r.gradient(F.col("pixels"), 8, 8)["gx"]), "l", "v")


def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples between the pixels of each raster."""
    p = F.col("pixels")
    x, y = (F.col("image") % 7) + 0.25, (F.col("label") % 7) + 0.5
    return rasters(spark, sf_dir).select("image", F.round(r.bilinear(p, x, y, 8, 8), 6).alias("inner"), F.round(r.bilinear(p, F.lit(7.5), y, 8, 8), 6).alias("edge"))


def clear_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of each raster without a frame of three pixels."""
    inner = F.aggregate(r.clear_frame(F.col("pixels"), 8, 8), F.lit(0.0), lambda s, v: s + v)
    return rasters(spark, sf_dir).select("image", F.round(inner, 6).alias("inner"))


def crossfield_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-field coefficients of two directions, and the product of the directions that come back."""
    a = F.col("pixels")
    u, v = r.cx(a[0] + 1, a[1]), r.cx(a[2], a[3] + 1)
    c = rasters(spark, sf_dir).select("image", r.crossfield_coefficients(u, v).alias("c"))
    c = c.withColumn("d", r.crossfield_directions(F.col("c.c0"), F.col("c.c2")))
    back = r.crossfield_coefficients(F.col("d.u"), F.col("d.v"))
    c = c.withColumn("b", back)
    return c.select("image", F.round("c.c0.re", 5).alias("c0_re"), F.round("c.c0.im", 5).alias("c0_im"), F.round("c.c2.re", 5).alias("c2_re"), F.round("b.c0.re", 5).alias("back_re"))


def align_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of a direction from a frame field."""
    a = F.col("pixels")
    c = r.crossfield_coefficients(r.cx(a[0] + 1, a[1]), r.cx(a[2], a[3] + 1))
    e = rasters(spark, sf_dir).select("image", r.align_error(c["c0"], c["c2"], r.cx(a[4] + 1, a[5])).alias("e"))
    return e.select("image", F.round("e", 6).alias("error"))


def pixel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the loss weights of each raster's pixels; NULL where the frequency of a pixel's class or a size is 0."""
    p = rasters(spark, sf_dir).select("image", "label", "pixels", F.transform("pixels", lambda v: F.abs(v) / 8).alias("distance"))
    freq = r.pixel_frequency(F.col("pixels"), F.when(F.col("label") == 0, 0.0).otherwise(F.col("label") / 16.0))
    p = p.withColumn("freq", freq).withColumn("size", F.transform("pixels", lambda v: F.abs(v) + 0.01))
    weights = F.zip_with(F.arrays_zip("freq", "distance"), "size", lambda x, size: r.pixel_weight(x["freq"], x["distance"], size, 8, 8))
    return p.select("image", F.round(F.aggregate(weights, F.lit(0.0), lambda s, v: s + v), 4).alias("weight"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rings(spark, sf_dir).select(F.floor(F.col("id") / 3).cast("bigint").alias("image"), F.col("id").alias("pos"), g.affine(F.col("a"), *[F.lit(v) for v in (1.0, 0.0, 0.25, 0.0, 1.0, 0.25)]).alias("ring"))
    return p


def raster_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled pixels per image and kind of mask."""
    m = kernels.rasterize(_shifted(spark, sf_dir), 32, 64)
    total = F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v)
    return m.select("image", "mask", F.round(total, 4).alias("total"))


def simple_polygonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of the rasters above 0."""
    p = kernels.polygonize(rasters(spark, sf_dir), 8, 8, level=0.0, tolerance=0.5, min_area=1.0, min_probability=0.0)
    return p.select("image", "poly", F.round("area", 6).alias("area"), F.round("probability", 6).alias("probability"), F.size("ring").alias("n_vertices"), "error")


def active_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the rasters above 0, fitted to them and to the frame field of their gradients."""
    framed = rasters(spark, sf_dir).withColumn("field", r.frame_field(F.col("pixels"), 8, 8))
    p = active.active_contours(framed, 8, 8, level=0.0, tolerance=0.5, min_area=1.0, min_probability=0.0)
    return p.select("image", "poly", F.round("area", 4).alias("area"), F.size("ring").alias("n_vertices"), "error")


def skeleton_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the skeletons of the rasters above 0."""
    p = rasters(spark, sf_dir).select("image", F.transform("pixels", lambda v: (v > 0).cast("double")).alias("pixels"))
    return skeletons.skeleton_paths(p, 8, 8)


def crop_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings cut by the boxes of their image, one after the other."""
    p = _shifted(spark, sf_dir).withColumnRenamed("pos", "poly")
    b = p.groupBy("image").agg(F.min("poly").alias("k")).select("image", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("box"))
    b = b.select("image", "box", (F.col("box") * 2.0).alias("x1"), F.lit(3.0).alias("y1"), (F.col("box") * 2 + 40.0).alias("x2"), (20.0 - F.col("box")).alias("y2"))
    c = kernels.crop_to_boxes(p, b)
    return c.select("image", "poly", "box", F.round(g.area(F.col("ring")), 6).alias("area"))


QUERIES = {
    f.__name__: f
    for f in (pixel_iou_thresholds, dice_loss, tversky_loss, cross_entropy, band_stats, tile_explode, tile_merge, laplacian, scharr_gradient, bilinear_sample, clear_frame, crossfield_uv, align_error, pixel_weights)
} | {f.__name__: f for f in (raster_masks, simple_polygonize, active_contours, skeleton_paths, crop_cascade)}

_PT = PIXELS_SQL + ", pt AS (SELECT image, i, greatest(0, least(1, v + 0.5::DOUBLE))::DOUBLE AS p, (u > 0)::INT AS y FROM px) "
_SUMS = "sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn"
_E = "embedding[{}]::DOUBLE"
_Z = {"ur": _E.format(1) + " + 1", "ui": _E.format(2), "vr": _E.format(3), "vi": _E.format(4) + " + 1", "zr": _E.format(5) + " + 1", "zi": _E.format(6)}
_CX = (
    "WITH z AS (SELECT vec_id AS image, " + ", ".join(f"{v} AS {k}" for k, v in _Z.items()) + " FROM embeddings), s AS (SELECT *, ur * ur - ui * ui AS ar, 2 * ur * ui AS ai, vr * vr - vi * vi AS br, 2 * vr * vi AS bi, zr * zr - zi * zi AS qr, 2 * zr * zi AS qi FROM z), "
    "c AS (SELECT *, ar * br - ai * bi AS c0r, ar * bi + ai * br AS c0i, -(ar + br) AS c2r, -(ai + bi) AS c2i FROM s) "
)


def _stencil_sql(kernel: list[list[float]], replicate: bool, outer: str) -> str:
    taps = ", ".join(f"({dr - 1}, {dc - 1}, {k!r}::DOUBLE)" for dr, line in enumerate(kernel) for dc, k in enumerate(line) if k)
    if replicate:
        on = "q.r = greatest(0, least(7, p.r + k.dr)) AND q.c = greatest(0, least(7, p.c + k.dc))"
    else:
        on = "q.r = p.r + k.dr AND q.c = p.c + k.dc"
    return PIXELS_SQL + f"SELECT p.image, p.i::BIGINT AS i, round({outer.format('sum(q.v * k.w)')}, 6) + 0.0::DOUBLE AS v FROM px p, (VALUES {taps}) k(dr, dc, w) JOIN px q ON q.image = p.image AND {on} GROUP BY p.image, p.i"


def _bilinear_sql(x: str, y: str) -> str:
    pick = "embedding[(greatest(0, least(7, floor({y}) + {b})) * 8 + greatest(0, least(7, floor({x}) + {a})) + 1)::INT]::DOUBLE"
    parts = []
    for a in (0, 1):
        for b in (0, 1):
            wx = f"({x} - floor({x}))" if a else f"(floor({x}) + 1 - {x})"
            wy = f"({y} - floor({y}))" if b else f"(floor({y}) + 1 - {y})"
            parts.append(f"{pick.format(x=x, y=y, a=a, b=b)} * {wx} * {wy}")
    return "round(" + " + ".join(parts) + ", 6)"


def _masks_sql() -> str:
    """All masks by pixel and edge: 32 x 64 pixels, lines of 3 and 2."""
    edges = "SELECT id // 3 AS image, id, ord, x + 0.25::DOUBLE AS x, y + 0.25::DOUBLE AS y, nx + 0.25::DOUBLE AS nx, ny + 0.25::DOUBLE AS ny FROM ea"
    along = "greatest(0, least(1, ((c + 0.5::DOUBLE - x) * (nx - x) + (r + 0.5::DOUBLE - y) * (ny - y)) / ((nx - x) * (nx - x) + (ny - y) * (ny - y))))"
    return (
        rings_sql()
        + f", e AS ({edges}), rc AS (SELECT r, c FROM range(32) a(r), range(64) b(c)), "
        "ar AS (SELECT id, abs(sum(x * ny - nx * y)) / 2 AS area FROM e GROUP BY id), "
        f"t AS (SELECT e.*, r, c, {along} AS t FROM e, rc), "
        "n AS (SELECT *, pow(c + 0.5::DOUBLE - x - t * (nx - x), 2) + pow(r + 0.5::DOUBLE - y - t * (ny - y), 2) AS d, pow(c + 0.5::DOUBLE - x, 2) + pow(r + 0.5::DOUBLE - y, 2) AS v, "
        "(y <= r + 0.5::DOUBLE) <> (ny <= r + 0.5::DOUBLE) AND c + 0.5::DOUBLE > x + (r + 0.5::DOUBLE - y) * (nx - x) / nullif(ny - y, 0) AS crossed FROM t), "
        "m AS (SELECT image, id, r, c, sum(coalesce(crossed, false)::INT) % 2 = 1 AS f, min(d) <= 2.25 AS b, min(v) <= 2.25 AS k FROM n GROUP BY ALL), "
        "own AS (SELECT image, id, r, c FROM m WHERE f OR b OR k), "
        "col AS (SELECT p.id, q.r, p.c, min(pow(p.r - q.r, 2)) AS g FROM own p, range(32) q(r) GROUP BY ALL), "
        "dist AS (SELECT p.id // 3 AS image, p.id, p.r, q.c, sqrt(min(p.g + pow(p.c - q.c, 2))) AS d FROM col p, range(64) q(c) GROUP BY ALL), "
        "two AS (SELECT image, r, c, d FROM dist QUALIFY row_number() OVER (PARTITION BY image, r, c ORDER BY d) <= 2), "
        "sz AS (SELECT image, r, c, arg_max(area, id) / 2048 AS s FROM dist JOIN ar USING (id) WHERE d <= 3 GROUP BY ALL), "
        "a AS (SELECT image, r, c, id, ord, (CASE WHEN atan2(nx - x, ny - y) < 0 THEN atan2(nx - x, ny - y) + pi() ELSE atan2(nx - x, ny - y) END) * 255 / pi() AS code FROM n WHERE d <= 1), "
        "cf AS (SELECT image, r, c, arg_max(round_even(code, 0), id * 4 + ord) AS code FROM a GROUP BY ALL), "
        "im AS (SELECT DISTINCT id // 3 AS image FROM va), "
        "s AS (SELECT image, 'polygon' AS mask, count(DISTINCT r * 64 + c) * 255 AS total FROM m WHERE f GROUP BY image "
        "UNION ALL SELECT image, 'boundary', count(DISTINCT r * 64 + c) * 255 FROM m WHERE b AND r BETWEEN 3 AND 28 AND c BETWEEN 3 AND 60 GROUP BY image "
        "UNION ALL SELECT image, 'vertex', count(DISTINCT r * 64 + c) * 255 FROM m WHERE k GROUP BY image "
        "UNION ALL SELECT image, 'crossfield', sum(code) FROM cf GROUP BY image "
        "UNION ALL SELECT image, 'distance', sum(d) / 96 FROM two GROUP BY image "
        "UNION ALL SELECT image, 'size', sum(s) + 2048 - count(*) FROM sz GROUP BY image) "
        "SELECT im.image::BIGINT AS image, k.mask, round(coalesce(s.total, 0)::DOUBLE, 4) AS total FROM im, (VALUES ('polygon'), ('boundary'), ('vertex'), ('crossfield'), ('distance'), ('size')) k(mask) LEFT JOIN s ON s.image = im.image AND s.mask = k.mask"
    )


_Y = "(label % 7 + 0.5::DOUBLE)"
SQL = {
    "pixel_iou_thresholds": PIXELS_SQL
    + ", t AS (SELECT unnest([-0.1, 0.0, 0.1, 0.25]::DOUBLE[]) AS threshold), c AS (SELECT image, label, threshold, sum((v > threshold AND u > threshold)::INT) AS a, sum((v > threshold OR u > threshold)::INT) AS b FROM px, t GROUP BY ALL) SELECT label, threshold, round(avg(CASE WHEN b = 0 THEN 1 ELSE a / b::DOUBLE END), 6) AS iou FROM c GROUP BY ALL",
    "dice_loss": _PT + "SELECT image, round(1 - (2 * sum(p * y) + 1) / (sum(y) + sum(p) + 1 + 1e-7), 6) AS dice FROM pt GROUP BY image",
    "tversky_loss": _PT
    + f", s AS (SELECT image, {_SUMS} FROM pt GROUP BY image), t AS (SELECT image, (tp + 1e-6) / (tp + 0.01::DOUBLE * fp + 0.99::DOUBLE * fn + 1e-6) AS t FROM s) SELECT image, round(t, 6) AS tversky, round(pow(greatest(1 - t, 0), 0.25::DOUBLE), 6) AS focal FROM t",
    "cross_entropy": "WITH l AS (SELECT vec_id AS image, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS z FROM embeddings), n AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lse FROM l) "
    "SELECT image, round(lse - z[label + 1], 6) AS ce, round(0.9::DOUBLE * (lse - z[label + 1]) + 0.1::DOUBLE * (lse - list_sum(z) / 10), 6) AS smooth_ce FROM n",
    "band_stats": PIXELS_SQL + "SELECT label, r::BIGINT AS band, round(avg(v), 6) + 0.0::DOUBLE AS mean, round(stddev_pop(v), 6) + 0.0::DOUBLE AS std, round(avg(v) / 255, 6) + 0.0::DOUBLE AS class_freq FROM px GROUP BY label, r",
    "tile_explode": "WITH d AS (SELECT row_id, greatest(1, ceil((width - 448) / 224.0::DOUBLE) + 1)::BIGINT AS nc, greatest(1, ceil((height - 448) / 224.0::DOUBLE) + 1)::BIGINT AS nr FROM dsg_dataset WHERE width IS NOT NULL AND height IS NOT NULL) SELECT row_id, r * nc + c AS tile_no, r * 224 AS row0, c * 224 AS col0 FROM d, LATERAL (SELECT unnest(range(nr)) AS r), LATERAL (SELECT unnest(range(nc)) AS c)",
    "tile_merge": PIXELS_SQL + "SELECT (image // 3)::BIGINT AS scene, (r + image % 3 * 2)::BIGINT AS row, c::BIGINT AS col, round(sum(v * (1 + image % 3)) / sum(1 + image % 3), 6) AS v FROM px GROUP BY 1, 2, 3",
    "laplacian": _stencil_sql(r.LAPLACIAN, False, "abs({})"),
    "scharr_gradient": _stencil_sql(r.GRADIENTS["scharr"], True, "{}"),
    "bilinear_sample": f"SELECT vec_id AS image, {_bilinear_sql('(vec_id % 7 + 0.25::DOUBLE)', _Y)} AS inner, {_bilinear_sql('7.5::DOUBLE', _Y)} AS edge FROM embeddings",
    "clear_frame": PIXELS_SQL + "SELECT image, round(sum(v) FILTER (r BETWEEN 3 AND 4 AND c BETWEEN 3 AND 4), 6) AS inner FROM px GROUP BY image",
    "crossfield_uv": _CX + "SELECT image, round(c0r, 5) AS c0_re, round(c0i, 5) AS c0_im, round(c2r, 5) AS c2_re, round(c0r, 5) AS back_re FROM c",
    "align_error": _CX
    + ", e AS (SELECT image, qr * qr - qi * qi + c2r * qr - c2i * qi + c0r AS er, 2 * qr * qi + c2r * qi + c2i * qr + c0i AS ei FROM c) SELECT image, round(er * er + ei * ei, 6) AS error FROM e",
    "pixel_weights": PIXELS_SQL
    + ", w AS (SELECT image, (1 / nullif(CASE WHEN v > 0 THEN label / 16.0::DOUBLE ELSE 1 - label / 16.0::DOUBLE END, 0) + 50 * exp(-pow(abs(v) / 8 * 16, 2) / 100)) * (1 + 1 / ((abs(v) + 0.01::DOUBLE) * 4)) AS w FROM px) "
    "SELECT image, CASE WHEN count(*) = count(w) THEN round(sum(w), 4) END AS weight FROM w GROUP BY image",
    "raster_masks": _masks_sql(),
}
