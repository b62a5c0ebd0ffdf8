import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrat.operators.packed import explode_packed, scan_packed


def values(text):
    parent, place, micro = scan_packed(pa.array([None, text, ""]))
    assert (parent == 1).all()
    return [(int(p), int(v) / 1e6) for p, v in zip(place, micro)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[np.float64(1.5), np.float64(nan), np.float64(3.25)]", [(1, 1.5), (3, 3.25)]),
        ("123,5 82,25", [(1, 123.5), (2, 82.25)]),
        ('"""1.5"",""2.5"""', [(1, 1.5), (2, 2.5)]),
        ('"""14,5"",""16,5"""', [(1, 14.5), (2, 16.5)]),
        ("'57,3';'19,9'", [(1, 57.3), (2, 19.9)]),
        ("9.5,,8.5", [(1, 9.5), (3, 8.5)]),
        (";;3.5", [(3, 3.5)]),
        (" / 1,5 / 2,5", [(2, 1.5), (3, 2.5)]),
        ("R: 1.5 | G: 2 | B: nan", [(1, 1.5), (2, 2.0)]),
        ("b1:3.5 b2: b3:5.5", [(1, 3.5), (3, 5.5)]),
        ("[1 2\n 3]", [(1, 1.0), (2, 2.0), (3, 3.0)]),
        ("12,34,56", [(1, 12.0), (2, 34.0), (3, 56.0)]),
        ("1.5e+02;NA;3;", [(1, 150.0), (3, 3.0)]),
        ("1,5  2,5", [(1, 1.5), (2, 2.5)]),
        ("115,5, 98,1", [(1, 115.5), (2, 98.1)]),
        ("array([1.5, 2.5], dtype=float32)", [(1, 1.5), (2, 2.5)]),
        ("-", []),
        ("[]", []),
        ("nan", []),
        ("1e300", []),
        ("F;;", []),
    ],
)
def test_notations(text, expected):
    assert values(text) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 10**9)), min_size=1, max_size=6), st.sampled_from([";", "|", " ; ", " / "]), st.booleans())
def test_round_trip(numbers, delimiter, comma):
    texts = ["" if n is None else f"{n / 1e6:.6f}".replace(".", "," if comma else ".") for n in numbers]
    found = scan_packed(pa.array([delimiter.join(texts)] * 2))
    expected = [(p, n) for p in (0, 1) for n in [(k, v) for k, v in enumerate(numbers, 1) if v is not None]]
    assert [(int(a), (int(b), int(c))) for a, b, c in zip(*found)] == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("0123456789.,;| \n\t'\"[]()eEnaRb:=-+/_é\xa0", max_size=40)), max_size=20))
def test_any_text_alone_or_in_a_batch(texts):
    together = {}
    for p, place, v in zip(*scan_packed(pa.array(texts, pa.string()))):
        together.setdefault(int(p), []).append((int(place), int(v)))
    for i, text in enumerate(texts):
        _, place, v = scan_packed(pa.array([text], pa.string()))
        assert together.get(i, []) == list(zip(place.tolist(), v.tolist()))
        if text is not None and not re.search(r"\d", text):
            assert i not in together


def test_table(spark):
    df = spark.createDataFrame([(1, "1;2", None, "x"), (1, "1;2", "nan", "y"), (2, None, "", None)], "row_id int, m string, s string, pos string")
    rows = [tuple(r) for r in explode_packed(df, "row_id", ["m", "s"]).collect()]
    assert sorted(rows) == sorted([(1, "m", 1, 10**6), (1, "m", 2, 2 * 10**6)] * 2)
    assert explode_packed(df.limit(0), "row_id", ["m"]).count() == 0


def test_very_long_text(spark):
    text = ";".join(["0.5"] * 200_000)
    assert explode_packed(spark.createDataFrame([(1, text)], "row_id int, m string"), "row_id", ["m"]).agg({"pos": "max"}).first()[0] == 200_000


def test_lists_and_slices(spark, monkeypatch):
    """One list per text with the ordinals of its parents; slices of any size give the same rows."""
    import pyarrow as pa

    from quadrat.operators import packed

    texts = pa.array(["1;2", None, "", "x", "[3, , 4]", "5" * 3, None])
    assert [[(v["pos"], v["value_micro"]) for v in row] for row in packed.packed_lists(texts).to_pylist()] == [[(1, 10**6), (2, 2 * 10**6)], [], [], [], [(1, 3 * 10**6), (3, 4 * 10**6)], [(1, 555 * 10**6)], []]
    df = spark.createDataFrame([(k, "; ".join(str(k + j) for j in range(k % 5)), None) for k in range(300)] + [(301, "7 " * 5000, "8")], "row_id bigint, a string, b string")
    whole = sorted(map(tuple, packed.explode_packed(df, "row_id", ["a", "b"]).collect()))
    monkeypatch.setattr(packed, "SLICE", 10)
    parts = list(packed._slices(pa.array(["12345", None, "1234567", "1" * 40, "", "2"])))
    assert [(int(a), int(b)) for a, b in parts] == [(0, 2), (2, 1), (3, 3)]
    assert sorted((k, "a", p + 1, v * 10**6) for k in range(300) for p, v in enumerate(k + j for j in range(k % 5))) + [(301, "a", p, 7 * 10**6) for p in range(1, 5001)] + [(301, "b", 1, 8 * 10**6)] == whole
