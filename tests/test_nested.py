import json

import pytest

from quadrat.operators.nested import flatten_annotations, node_table, nodes, state


def found(body):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return sorted((k, p, o) for _, k, p, o, _ in nodes(text))


RING = [[0, 0], [1, 0], [1, 1]]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (None, []),
        ("", []),
        ('{"polygon": [[0, 0]', []),
        ("null", []),
        ([], []),
        ({"objects": None}, []),
        ({"imgWidth": 5, "objects": []}, []),
        ({"polygon": RING}, [("ring", "polygon[0]", "$")]),
        ({"polygon": [RING, [], RING]}, [("ring", "polygon[0]", "$"), ("ring", "polygon[2]", "$")]),
        ([{"class": 1, "bbox": [1, 2, 3, 4], "attributes": {"name": "a"}}, None], [("attribute", "[0].attributes[0]", "[0]"), ("box", "[0]", "$")]),
        ({"boxes": {"class": 1, "bbox": [1, 2, 3, 4]}}, [("box", "boxes[0]", "$")]),
        ({"objects": json.dumps([{"polygon": RING}])}, [("object", "objects[0]", "$"), ("ring", "objects[0].polygon[0]", "objects[0]")]),
        (
            {"objects": {"polygon": [], "holes": [RING], "parts": [{"polygon": RING, "attributes": [None, {"name": "x"}]}]}},
            [
                ("attribute", "objects[0].parts[0].attributes[1]", "objects[0].parts[0]"),
                ("object", "objects[0]", "$"),
                ("object", "objects[0].parts[0]", "objects[0]"),
                ("ring", "objects[0].holes[0]", "objects[0]"),
                ("ring", "objects[0].parts[0].polygon[0]", "objects[0].parts[0]"),
            ],
        ),
        (
            {"images": [{"id": "7"}, {"id": 8}], "categories": [], "licenses": [{"id": 1}], "annotations": [{"image_id": 7, "segmentation": [[0, 0, 1, 0, 1, 1]]}, {"image_id": 9, "segmentation": {"counts": [1, 2], "size": [1, 3]}}, {"image_id": 8, "segmentation": [0, 0, 1, 0, 1, 1]}]},
            [
                ("annotation", "annotations[0]", "images[0]"),
                ("annotation", "annotations[1]", ""),
                ("annotation", "annotations[2]", "images[1]"),
                ("image", "images[0]", "$"),
                ("image", "images[1]", "$"),
                ("license", "licenses[0]", "$"),
                ("ring", "annotations[0].segmentation[0]", "annotations[0]"),
                ("ring", "annotations[2].segmentation[0]", "annotations[2]"),
            ],
        ),
    ],
)
def test_bodies(body, expected):
    assert found(body) == sorted(expected)


def test_texts_within_lists_and_ids():
    body = {"images": json.dumps([{"id": 7.0}, {"id": 7}]), "annotations": [json.dumps({"image_id": " 7"})]}
    assert found(body) == [("annotation", "annotations[0]", "images[0]"), ("image", "images[0]", "$"), ("image", "images[1]", "$")]


def test_states():
    assert [state(v) for v in (None, 1, True, "a", [1, 2], [1, 2, 3, 4], RING, [RING], {}, [{}], [1], [], "[[1, 2], [3, 4]]")] == [
        "null", "number", "flag", "text", "pair", "ring", "ring", "rings", "record", "records", "other", "empty", "ring",
    ]


def test_deep_nesting():
    body = {"class": 1}
    for _ in range(300):
        body = {"parts": [body]}
    assert len(found({"objects": [body]})) == 301


@pytest.mark.parametrize("depth", [3_000, 200_000])
def test_any_depth(depth):
    """Deep rings, objects and plain members; the parser and the writer have no limit either."""
    deep = "[" * depth + "]" * depth
    assert found('{"objects": [{"class": 1, "polygon": ' + deep + ', "holes": [[0, 0, 1, 0, 1, 1]]}]}') == [("object", "objects[0]", "$"), ("ring", "objects[0].holes[0]", "objects[0]")]
    (node,) = nodes('{"bbox": [1, 2, 3, 4], "x": ' + deep + "}")
    assert node[4] == '{"bbox":[1,2,3,4],"x":' + deep + "}"
    assert found('{"polygon": ' + "[" * depth + "]" * (depth - 1) + "}") == []
    levels = 3_000
    assert len(found('{"objects": [' + '{"parts": [' * levels + "{}" + "]}" * levels + "]}")) == levels + 1


def test_deep_parser_agrees_with_the_usual_one():
    from quadrat.operators.nested import _parse_deep

    for text in ('{"a": [1, -2.5e3, "x\\n\\u00e9", {}, [], null, true, {"b": [[0]]}], "c": false} ', "[]", "3", '"x"', " [ 1 , 2 ] "):
        assert _parse_deep(text) == json.loads(text)
    for text in ("", "[1,]", "{1: 2}", '{"a" 1}', "[1 2]", "[1]]", '{"a": }', "[", '{"a": 1', "nul"):
        with pytest.raises((ValueError, IndexError)):
            _parse_deep(text)


def test_states_decide_the_variant():
    assert state({"objects": 5, "polygon": RING}) == "shape" and found({"objects": 5, "polygon": RING}) == [("ring", "polygon[0]", "$")]
    assert [state(v) for v in ({"images": None}, {"imgWidth": "5"}, {"boxes": []}, {"bbox": [1, 2, 3, 4]}, {"attributes": []}, [{"bbox": None}, {"objects": []}])] == ["coco", "polygons", "boxes", "box", "record", "records"]


def test_tables(spark):
    coco = json.dumps({"images": [{"id": 1, "file_name": "a.tif"}], "annotations": [{"id": 5, "image_id": "1", "area": 2.5, "bbox": [1, 2, 3, 4]}]})
    df = spark.createDataFrame([(1, coco, "x"), (1, coco, "x"), (2, None, None)], "file_id int, body string, node_kind string")
    flat = flatten_annotations(df)
    assert flat.count() == 4
    rows = node_table(flat, "annotation").select("file_id", "parent_path", "id", "image_id", "area", "bbox").distinct().collect()
    assert [tuple(r) for r in rows] == [(1, "images[0]", "5", "1", 2.5, [1.0, 2.0, 3.0, 4.0])]
    assert flatten_annotations(df.limit(0)).count() == 0
