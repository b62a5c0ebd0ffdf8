import random
from datetime import datetime, timedelta

from quadrat.functions.paths import PLACEHOLDERS
from quadrat.operators.references import orphan_references, orphans_by_period

DAY = datetime(2024, 1, 1)


def at(d):
    return None if d is None else DAY + timedelta(hours=d)


def orphans(spark, refs, files):
    a = spark.createDataFrame([(i, at(t), p, q, "z") for i, t, p, q in refs], "row_id bigint, listed timestamp, image string, mask string, h1 string")
    b = spark.createDataFrame([(p, at(s), at(d), 1) for p, s, d in files], "path string, stored timestamp, deleted timestamp, day int")
    return orphan_references(a, "row_id", ["image", "mask"], "listed", b, "path", "stored", "deleted")


def test_reasons(spark):
    refs = [(1, 10, "A//b.tif", None), (2, 10, "./gone", "nan"), (3, 10, "later", ""), (4, 10, "never", "never"), (5, 10, " /a\\B.TIF ", "None"), (6, None, "gone", "never"), (7, 5, "gone", None)]
    files = [("a/b.tif", 5, None), ("gone", 1, 10), ("later", 11, None), ("later", 1, 9), ("gone", None, None), (None, 1, None), ("a/b.tif", 5, None)]
    got = sorted((r["row_id"], r["ref_field"], r["reason"]) for r in orphans(spark, refs, files).collect())
    assert got == [(2, "image", "deleted"), (3, "image", "late"), (4, "image", "missing"), (4, "mask", "missing"), (6, "image", "deleted"), (6, "mask", "missing")]


def test_against_brute_force(spark):
    rng = random.Random(5)
    names = [f"p{k}" for k in range(6)] + ["nan"]
    hot = lambda: "hot" if rng.random() < 0.4 else rng.choice(names)
    refs = [(i, rng.randrange(200), hot(), rng.choice([*names, None])) for i in range(400)]
    files = [(hot(), s := rng.randrange(200), rng.choice([None, s + rng.randrange(-5, 80)])) for _ in range(60)]
    expected = []
    for i, t, *paths in refs:
        for field, path in zip(("image", "mask"), paths):
            if path is None or path in PLACEHOLDERS:
                continue
            own = [(s, d) for p, s, d in files if p == path]
            if any(s <= t and not (d is not None and d <= t) for s, d in own):
                continue
            expected.append((i, field, "missing" if not own else "late" if any(s > t for s, _ in own) else "deleted"))
    got = [(r["row_id"], r["ref_field"], r["reason"]) for r in orphans(spark, refs, files).collect()]
    assert sorted(got) == sorted(expected)


def test_empty_and_counts(spark):
    assert orphans(spark, [], []).count() == 0
    got = orphans_by_period(orphans(spark, [(1, 0, "x", "y"), (1, 0, "x", None)], []))
    assert sorted((r["ref_field"], r["period"], r["reason"], r["n"]) for r in got.collect()) == [("image", "2024-01", "missing", 2), ("mask", "2024-01", "missing", 1)]


def test_hot_key_is_cut_without_loss(spark, monkeypatch):
    """A key that holds most references, many of one moment, is spread over many partitions."""
    from quadrat.operators import references

    monkeypatch.setattr(references, "PER_PARTITION", 40)
    refs = [(i, 7 if i % 2 else i % 24, "hot" if i % 5 else f"p{i % 3}", None) for i in range(600)]
    files = [("hot", 3, 5), ("hot", 4, 9), ("hot", 20, 21), ("p1", 0, 2), ("p1", 30, None)]
    expected = []
    for i, t, path, _ in refs:
        own = [(s, d) for p, s, d in files if p == path]
        if not any(s <= t and not (d is not None and d <= t) for s, d in own):
            expected.append((i, "missing" if not own else "late" if any(s > t for s, _ in own) else "deleted"))
    rows = orphans(spark, refs, files)
    assert sorted((r["row_id"], r["reason"]) for r in rows.collect()) == sorted(expected)


def test_times_without_zone(spark):
    a = spark.sql("SELECT 1L AS row_id, TIMESTAMP_NTZ'2024-03-31 02:30:00' AS listed, 'x' AS image")
    b = spark.sql("SELECT 'x' AS path, TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS stored, CAST(NULL AS TIMESTAMP_NTZ) AS deleted")
    got = orphan_references(a, "row_id", ["image"], "listed", b, "path", "stored", "deleted")
    assert [(r["reason"], r["at"].isoformat()) for r in got.collect()] == [("late", "2024-03-31T02:30:00")]
    assert orphans_by_period(got).first()["period"] == "2024-03"
