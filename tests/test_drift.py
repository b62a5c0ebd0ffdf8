import json

import numpy as np

from quadrat.operators.drift import flood, match_fields, schema_changes, unified_records

SCHEMA = "record_id bigint, series string, file_seq int, line_no int, kind string, body string"


def lines(series, seq, rows, start=0):
    return [(start + i, series, seq, i, "x", r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)]


def changes(spark, data):
    return sorted(tuple(r) for r in schema_changes(spark.createDataFrame(data, SCHEMA)).collect())


def test_all_kinds(spark):
    images = [f"i{k}" for k in range(10)]
    a = [{"image": i, "width": k, "mask": f"m{k}", "flag": True, "old": 1, "odd": None} for k, i in enumerate(images)]
    b = [{"image": i, "largura": k, "mask": [f"m{k}"], "flag": True, "new": 2.5, "odd": None} for k, i in enumerate(images)]
    b[0]["stray"] = 1
    data = lines("s", 1, [*a, "{broken", None, "[1]"]) + lines("s", 4, b) + lines("t", 1, a)
    assert changes(spark, data) == [
        ("s", 4, "added", "", "new"),
        ("s", 4, "removed", "old", ""),
        ("s", 4, "renamed", "width", "largura"),
        ("s", 4, "retyped", "mask", "mask"),
    ]


def test_types_by_majority_and_null_fields(spark):
    a = [{"image": f"i{k}", "n": 1 if k else "x", "z": None} for k in range(5)]
    b = [{"image": f"i{k}", "n": 1.0, "z": 3} for k in range(5)]
    assert changes(spark, lines("s", 1, a) + lines("s", 2, b)) == [("s", 2, "retyped", "n", "n")]


def test_half_is_not_more_than_half(spark):
    a = [{"image": f"i{k}", **({"n": 1} if k < 2 else {})} for k in range(4)]
    b = [{"image": f"i{k}", "n": 1} for k in range(4)]
    assert changes(spark, lines("s", 1, a) + lines("s", 2, b)) == [("s", 2, "added", "", "n")]


def test_no_common_images_is_no_rename(spark):
    a, b = [{"image": "a", "w": 1}], [{"image": "b", "v": 1}]
    assert changes(spark, lines("s", 1, a) + lines("s", 2, b)) == [("s", 2, "added", "", "v"), ("s", 2, "removed", "w", "")]


def test_empty_and_late_files(spark):
    assert changes(spark, []) == []
    a = [{"image": "a", "w": 1}]
    assert changes(spark, lines("s", 3, a) + lines("s", 1, [{"image": "a", "w": 1, "x": 1}])) == [("s", 3, "removed", "x", "")]
    assert changes(spark, lines("s", 1, ["{"]) + lines("s", 2, a)) == []


def test_matching_prefers_agreement_then_names():
    old, new = [("width", "integer"), ("height", "integer")], [("w", "integer"), ("imgWidth", "integer")]
    shares = {("width", "w"): 0.85, ("width", "imgWidth"): 1.0, ("height", "w"): 0.0}
    assert match_fields(old, new, shares) == [("width", "imgWidth")]
    assert flood([], new, np.zeros((0, 2))).shape == (0, 2)
    assert match_fields(old, [], {}) == []


def test_flooding_decides_between_equal_values(spark):
    """Where values agree alike, names, types and nested members decide, also against the order of the fields."""
    old, new = [("height", "integer"), ("width", "integer")], [("a_width", "integer"), ("b_height", "integer")]
    same = {(o[0], n[0]): 1.0 for o in old for n in new}
    assert match_fields(old, new, same) == [("height", "b_height"), ("width", "a_width")]
    shapes = [("boxes", "array", "ARRAY<OBJECT<bbox: ARRAY<BIGINT>, class: BIGINT>>"), ("polys", "array", "ARRAY<OBJECT<polygon: ARRAY<ARRAY<DOUBLE>>>>")]
    turned = [("c1", "array", shapes[1][2]), ("c2", "array", shapes[0][2])]
    assert sorted(match_fields(shapes, turned, {(o[0], n[0]): 1.0 for o in shapes for n in turned})) == [("boxes", "c2"), ("polys", "c1")]
    a = [{"image": f"i{k}", "height": 512, "width": 512} for k in range(6)]
    b = [{"image": f"i{k}", "a_width": 512, "b_height": 512} for k in range(6)]
    assert changes(spark, lines("s", 1, a) + lines("s", 2, b)) == [("s", 2, "renamed", "height", "b_height"), ("s", 2, "renamed", "width", "a_width")]


def test_members_of_shapes():
    from quadrat.operators.drift import _members

    assert _members("ARRAY<OBJECT<bbox: ARRAY<BIGINT>, at: OBJECT<x: DOUBLE>, class: BIGINT>>") == [(-1, "bbox", "ARRAY"), (-1, "at", "OBJECT"), (1, "x", "DOUBLE"), (-1, "class", "BIGINT")]
    assert _members("ARRAY<BIGINT>") == _members(None) == []


def test_unified(spark):
    a = [{"image": f"i{k}", "width": k} for k in range(3)]
    b = [{"image": f"i{k}", "largura": k} for k in range(3)]
    c = [{"image": f"i{k}", "w": str(k), "flag": True} for k in range(3)]
    df = spark.createDataFrame(lines("s", 1, a) + lines("s", 2, b, 10) + lines("s", 3, [*c, "{"], 20), SCHEMA)
    rows = {r["record_id"]: r["fields"] for r in unified_records(df).collect()}
    assert rows[1] == rows[11] == {"width": "1"}
    assert rows[21] == {"width": "1", "flag": "true"}
    assert rows[23] is None


def test_unified_casts_to_common_types(spark):
    a = [{"image": f"i{k}", "width": 512, "gsd": 10, "mask": f"m{k}", "flag": True, "box": [1, 2], "Flag": "x"} for k in range(4)]
    b = [{"image": f"i{k}", "largura": 512.0, "gsd": "2.5", "mask": f"m{k}", "flag": 0, "box": "none", "fields": 1} for k in range(3)]
    a[3] |= {"width": "wide", "gsd": 1.5, "mask": ["m3"], "stray": 7}
    df = spark.createDataFrame(lines("s", 1, a) + lines("s", 2, b, 10) + lines("s", 3, [{"image": "i0", "gsd": 1.25}, "{"], 20), SCHEMA)
    got = unified_records(df)
    types = dict(got.dtypes)
    assert [types[c] for c in ("width", "gsd", "mask", "Flag", "flag_2", "box", "fields_2")] == ["double", "double", "string", "string", "boolean", "array<string>", "bigint"]
    rows = {r["record_id"]: r.asDict() for r in got.collect()}
    assert (rows[0]["flag_2"], rows[10]["flag_2"]) == (True, False)
    assert (rows[0]["width"], rows[0]["gsd"], rows[0]["mask"], rows[0]["box"]) == (512.0, 10.0, "m0", ["1", "2"])
    assert (rows[10]["width"], rows[10]["gsd"], rows[10]["box"], rows[10]["fields_2"]) == (512.0, 2.5, None, 1)
    assert rows[10]["uncast"] == {"box": "none"} and rows[0]["uncast"] == {}
    assert rows[3]["uncast"] == {"width": "wide", "mask": '["m3"]', "stray": "7"}
    assert rows[21]["uncast"] is None and rows[21]["width"] is None
