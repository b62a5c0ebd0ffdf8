import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.llm.components import components
from quadrat.llm.overlap import cross_split_pairs, overlap_report, split_of
from quadrat.llm.splits import assign_splits, closest_subset, grouped, plan_splits
from quadrat.llm.tiles import located, tile_of

NAMES = [
    ("images/Ortoimagem_MI_5971-1-NO/Ortoimagem_MI_5971-1-NO_362.tif", ["5971-1-NO"], 362),
    ("/srv/acervo/images/3838-2-NO/3838-2-NO_23.tif", ["3838-2-NO"], 23),
    ("images/MI6585_1_SO/000162.tif", ["6585-1-SO"], 162),
    ("images/188__7767-2-so.tif ", ["7767-2-SO"], 188),
    ("file:///d/images/MI-2398-2-NE/T176_copia.tif", ["2398-2-NE"], 176),
    ("images/ortoimagen_mi_40183ne_34.tif", ["4018-3-NE"], 34),
    ("images\\Ortoimagem%20MI%208080-1-SO\\recorte%2071_aug3.tif", ["8080-1-SO"], 71),
    ("images/Ortoimagem_MI_4769-2-SO+4650-1-SO/Ortoimagem_MI_4769-2-SO+4650-1-SO_39.tif", ["4650-1-SO", "4769-2-SO"], 39),
    ("images/mosaico_5475-3-NE_8571-4-NO/00008.tif", ["5475-3-NE", "8571-4-NO"], 8),
    ("images/173__4413-2-no__1388-3-no.tif", ["1388-3-NO", "4413-2-NO"], 173),
    ("images/Ortoimagem_MI_8O59-l-N0/Ortoimagem_MI_8O59-l-N0_14 (1).tif", ["8059-1-NO"], 14),
    ("images/Ortoimagem_MI_3869-4-SO/Ortoimagem_MI_3869-4-SO_98_recorte2.tif", ["3869-4-SO"], 98),
    ("images/lote_29/img_52af7189.tif", [], None),
    ("", [], None),
]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in NAMES], "p string").withColumn("t", tile_of(F.col("p")))
    got = {r["p"]: (r["t"]["sheets"], r["t"]["number"]) for r in df.collect()}
    for name, sheets, number in NAMES:
        assert got[name][0] == sheets
        assert not sheets or got[name][1] == number


def tile_list(spark, rows):
    return spark.createDataFrame(rows, "image_path string, label_path string")


def test_lookup(spark):
    rows = spark.createDataFrame([(1, "./images/lote_1/img_0a.TIF"), (2, "images/lote_2/img_0b.tif"), (3, None), (4, NAMES[0][0])], "rec_id bigint, path string")
    lists = tile_list(spark, [("images\\lote_1\\img_0a.tif", "labels/MI6585_1_SO/000162.tif"), ("images/lote_1/img_0a.tif", None), (None, "labels/MI6585_1_SO/000163.tif")])
    got = {r["rec_id"]: (r["sheets"], r["number"]) for r in located(rows, lists).collect()}
    assert got == {1: (["6585-1-SO"], 162), 2: ([], None), 3: ([], None), 4: (["5971-1-NO"], 362)}


def brute_roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("case", ["chain", "random", "empty"])
def test_components(spark, case):
    rng = random.Random(1)
    edges = {"chain": [(f"n{k:03}", f"n{k + 1:03}") for k in range(120)], "random": [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(45)] + [(None, "n001")], "empty": []}[case]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute_roots(edges)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 60))
def test_closest_subset(sizes, target):
    sums = {0}
    for size, n in sizes.items():
        sums = {s + size * k for s in sums for k in range(n + 1)}
    taken = closest_subset(sizes, target)
    assert all(n <= sizes[s] for s, n in taken.items())
    assert abs(sum(s * n for s, n in taken.items()) - target) == min(abs(s - target) for s in sums)


def test_plan_takes_every_group_once():
    sizes = {1: 50, 7: 3, 400: 1}
    plan = plan_splits(sizes, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
    for size, n in sizes.items():
        assert sorted(r for s, _, a, b in plan if s == size for r in range(a, b + 1)) == list(range(1, n + 1))


def test_splits_keep_groups(spark):
    rng = random.Random(2)
    sheets = [f"{k}-{1 + k % 4}-NE" for k in range(1000, 1060)]
    paths = [(i, f"images/MI-{rng.choice(sheets) if i % 3 else sheets[0]}/T{i}.tif") for i in range(600)]
    paths += [(1000 + k, f"images/mosaico_{sheets[k]}_{sheets[k + 1]}/0000{k}.tif") for k in range(1, 6)] + [(2000, None)]
    rows = spark.createDataFrame(paths, "rec_id bigint, path string")
    groups = grouped(rows, tile_list(spark, []))
    got = assign_splits(groups, spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2)], "split string, portion double")).collect()
    assert len(got) == len(paths)
    by_group = {}
    for r in got:
        assert r["split"] in ("train", "val", "test")
        if r["group_id"] is not None:
            by_group.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    assert {r["group_id"] for r in got if r["rec_id"] in range(1001, 1006)} == {sheets[1]}
    counts = {s: sum(r["split"] == s for r in got) for s in ("train", "val", "test")}
    assert abs(counts["val"] - 121) <= 3 and abs(counts["test"] - 121) <= 3
    assert assign_splits(groups.limit(0), spark.createDataFrame([("train", 1.0)], "split string, portion double")).count() == 0


def test_split_spellings(spark):
    words = ["TRAIN ", "treino", " Val", "validation", "teste", "test", "other", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, s string").orderBy("k").select(split_of(F.col("s"))).collect()]
    assert got == ["train", "train", "val", "val", "test", "test", None, None, None]


def test_overlaps(spark):
    a, b = "images/MI-2398-2-NE/T176.tif", "images\\Ortoimagem%20MI%202398-2-NE\\recorte%20176_rot90.png"
    rows = [(1, "train", "p", a), (2, "Val", "q", b), (3, "test", None, b), (4, None, "p", a), (5, "treino", "r", b), (6, "val", "q", "images/MI-2398-2-NE/T177.tif"), (7, "val", "q", "images/lote_1/img_0a.tif"), (8, "val", "q", None)]
    lists = tile_list(spark, [("images/lote_1/img_0a.tif", "labels/176__2398-2-ne.tif")])
    df = spark.createDataFrame(rows, "rec_id bigint, split string, producer string, path string")
    pairs = cross_split_pairs(df, lists)
    assert sorted((r["eval_id"], r["train_id"]) for r in pairs.collect()) == [(2, 1), (2, 5), (3, 1), (3, 5), (7, 1), (7, 5)]
    report = {tuple(r)[:3]: tuple(r)[3:] for r in overlap_report(df, lists).collect()}
    assert report == {("val", "q", "p"): (2, 2), ("val", "q", "r"): (2, 2), ("test", None, "p"): (1, 1), ("test", None, "r"): (1, 1)}
    assert overlap_report(df.limit(0), lists).count() == 0


def test_hot_tile(spark):
    """A tile that holds most training rows is cut into slices; no pair is lost or doubled."""
    from quadrat.session import salted_join

    left = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("l"))
    for n in (20, 700):
        right = spark.range(n).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("r"))
        plain, salted = left.join(right, "k"), salted_join(left, right, ["k"], per_slice=100)
        assert salted.count() == plain.count() == salted.select("l", "r").distinct().count()


@pytest.mark.parametrize("rows", [50_000_000, 220_000_000])
def test_totals_are_exact_for_many_rows(rows):
    plan = plan_splits({1: rows}, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
    assert {s: sum(size * (b - a + 1) for size, x, a, b in plan if x == s) for s in ("val", "test")} == {"val": rows // 10, "test": rows // 10}


def test_totals_are_exact_for_mixed_sizes():
    sizes = {1: 3, 7: 2_000_000, 640: 40_000, 99_991: 12}
    target = 0.1 * sum(s * n for s, n in sizes.items())
    taken = closest_subset(sizes, target)
    assert all(n <= sizes[s] for s, n in taken.items())
    assert abs(sum(s * n for s, n in taken.items()) - target) <= 0.5
