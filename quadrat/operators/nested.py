"""Deeply nested annotation bodies as related flat tables.

A tree automaton reads every JSON value bottom-up and gives it a state.  Of lists: ``empty``,
``pair`` (two numbers), ``ring`` (pairs, or numbers run together), ``rings``, ``records`` or ``other``;
of objects, by the states of their members: ``coco``, ``polygons``, ``boxes``, ``box``, ``shape`` (rings of
its own) or plain ``record``; else ``null``, ``number``, ``text`` or ``flag``.  The state of a body is its
variant, and each variant has a route: which members hold records of which kind.  Within records, the
states of the members tell what is a ring.  Nodes of all kinds share the columns
``file_id, node_kind, node_path, parent_path``; the rest of a node is kept as JSON and cast into
the typed table of its kind by :func:`node_table`.

Cases and their result
----------------------
* NULL, blank and broken bodies: no node.  Empty and null lists and members: no node.
* A member alone where a list is usual is position 0; a null element keeps its position.
* A text holding a JSON list or object is read as if nested; any other text is no list.
* Values nest at any depth: parser, automaton and routes keep stacks of their own.
* A file sent twice gives its nodes per ``file_id``; the same ``file_id`` twice gives them twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from json.decoder import scanstring
from json.scanner import NUMBER_RE
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = "file_id bigint, variant string, node_kind string, node_path string, parent_path string, payload string"
#: Members that hold objects within an object.
_CHILDREN = ("parts", "objects", "children")
_RINGS = ("polygon", "holes", "segmentation")
_OWN = {*_RINGS, "attributes", *_CHILDREN}
_RECORDS = {"coco", "polygons", "boxes", "box", "shape", "record"}
_LIST = _RECORDS | {"records", "empty", "null", "other"}
_SCALAR = {"number", "text", "null"}
#: Transitions of objects: the first state that a member of an accepted state speaks for.
_SHAPES = (
    ("coco", {"annotations": _LIST, "images": _LIST, "categories": _LIST}),
    ("polygons", {"objects": _LIST, "imgWidth": _SCALAR, "imgHeight": _SCALAR}),
    ("boxes", {"boxes": _LIST}),
    ("box", {"bbox": {"ring", "pair", "rings", "other", "empty", "null", "text"} | _RECORDS}),
    ("shape", dict.fromkeys(_RINGS, {"ring", "rings", "pair", "other"})),
)
#: Which members of a variant hold records, and of which kind; a body that is a list holds boxes.
_ROUTES = {"coco": (("images", "image"), ("categories", "category"), ("licenses", "license"), ("annotations", "annotation")), "polygons": (("objects", "object"),), "boxes": (("boxes", "box"),)}
_VARIANTS = {"coco": "coco", "polygons": "polygons", "boxes": "boxes", "box": "boxes", "records": "boxes", "other": "boxes", "shape": "cropped", "record": "cropped"}
_NUMBERS = {int, float}
_WORDS = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _parse_deep(text: str) -> Any:
    """``json.loads`` with a stack of its own, for values nested beyond the interpreter's limit."""
    blank = " \t\n\r"
    stack: list[tuple[Any, str | None]] = []  # open containers, and the key that waits for a value
    at, n = 0, len(text)

    def skip(at: int) -> int:
        while at < n and text[at] in blank:
            at += 1
        return at

    def key_at(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("a key must be a string")
        key, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("a key must have a value")
        return key, at + 1

    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            value: Any = [] if c == "[" else {}
            inner = skip(at + 1)
            if text[inner : inner + 1] == ("]" if c == "[" else "}"):
                at = inner + 1
            else:
                key, at = (None, inner) if c == "[" else key_at(inner)
                stack.append((value, key))
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif (word := next((w for w in _WORDS if text.startswith(w, at)), None)) is not None:
            value, at = _WORDS[word], at + len(word)
        elif (found := NUMBER_RE.match(text, at)) is not None:
            value, at = (float if found[2] or found[3] else int)(found[0]), found.end()
        else:
            raise ValueError("no value")
        while True:  # put the value away, and close what ends behind it
            at = skip(at)
            if not stack:
                if at < n:
                    raise ValueError("extra data")
                return value
            holder, key = stack.pop()
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            c, at = text[at : at + 1], at + 1
            if c == ",":
                if key is not None:
                    key, at = key_at(skip(at))
                stack.append((holder, key))
                break
            if c != ("]" if key is None else "}"):
                raise ValueError("a comma or an end is missing")
            value = holder


def _parse(text: str) -> Any:
    """What a JSON text holds; None if it is broken."""
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _parse_deep(text)
        except (ValueError, IndexError):
            return None
    except ValueError:
        return None


def _nested(value: Any) -> Any:
    """``value``; if it is a JSON text of a list or an object, what it holds."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        value = _parse(value)
    return value


def _numeric(value: list) -> str | None:
    """The state of a list of numbers, or of pairs of numbers; None for other lists."""
    kinds = set(map(type, value))
    if kinds <= _NUMBERS:
        return "empty" if not value else "pair" if len(value) == 2 else "ring" if len(value) % 2 == 0 else "other"
    if kinds == {list} and set(map(len, value)) == {2} and set(map(type, chain.from_iterable(value))) <= _NUMBERS:
        return "ring"
    return None


def _list_state(value: list, inner: set[str]) -> str:
    """The state of a list from those of its elements."""
    inner = inner - {"null", "empty"}
    if not inner:
        return "empty"
    if inner == {"number"}:
        return "pair" if len(value) == 2 else "ring" if len(value) % 2 == 0 else "other"
    if inner == {"pair"}:
        return "ring"
    if inner <= {"ring", "pair"}:
        return "rings"
    return "records" if inner <= _RECORDS else "other"


def _object_state(members: dict[str, str]) -> str:
    """The state of an object from those of its members."""
    for name, evidence in _SHAPES:
        for member, accepted in evidence.items():
            if members.get(member) in accepted:
                return name
    return "record"


class Automaton:
    """States of all values of a body, computed once, from the leaves up.

    JSON texts are put in place of what they hold, so that the body is one tree.
    """

    def __init__(self, top: Any) -> None:
        self.top = _nested(top)
        self._states: dict[int, str] = {}
        order, stack = [], [self.top]
        while stack:
            value = stack.pop()
            if isinstance(value, list):
                known = _numeric(value)
                if known is not None:
                    self._states[id(value)] = known
                    continue
                places = enumerate(value)
            elif isinstance(value, dict):
                places = value.items()
            else:
                continue
            order.append(value)
            for place, item in places:
                if isinstance(item, str):
                    item = value[place] = _nested(item)
                if isinstance(item, (list, dict)):
                    stack.append(item)
        for value in reversed(order):
            if isinstance(value, list):
                self._states[id(value)] = _list_state(value, {self.state(x) for x in value})
            else:
                self._states[id(value)] = _object_state({k: self.state(v) for k, v in value.items()})

    def state(self, value: Any) -> str:
        """The state of a value of the body."""
        if isinstance(value, (list, dict)):
            found = self._states.get(id(value))
            return found if found is not None else _numeric(value)  # a pair within a ring was read with it
        if value is None:
            return "null"
        return "flag" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"

    def rings(self, value: Any) -> list[tuple[int, Any]]:
        """Position and coordinates of the rings in a member for rings."""
        kind = self.state(value)
        if kind in ("ring", "pair"):
            return [(0, value)]
        if not isinstance(value, list):
            return []
        accepted = ("ring", "pair") if kind == "rings" else ("ring",)  # one odd ring doesn't hide the others
        return [(i, x) for i, x in enumerate(value) if self.state(x) in accepted]


def state(value: Any) -> str:
    """The automaton's state of a single value."""
    automaton = Automaton(value)
    return automaton.state(automaton.top)


def _items(value: Any) -> list[Any]:
    """The list that ``value`` is or stands for."""
    return [] if value is None or value == "" else value if isinstance(value, list) else [value]


def _name(value: Any) -> str:
    """An id as text, quoted or not, whole numbers alike however they are written."""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).strip()


def _json(value: Any) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out, stack = [], [(value, "")]
        while stack:
            item, before = stack.pop()
            out.append(before)
            if isinstance(item, (list, dict)) and item:
                parts = item.items() if isinstance(item, dict) else ((None, x) for x in item)
                inner = [(x, ("," if k else "") + ("" if key is None else json.dumps(key, ensure_ascii=False) + ":")) for k, (key, x) in enumerate(parts)]
                out.append("{" if isinstance(item, dict) else "[")
                stack.append((_End, "}" if isinstance(item, dict) else "]"))
                stack += reversed(inner)
            elif item is not _End:
                out.append(json.dumps(item, ensure_ascii=False))
        return "".join(out)


_End = object()
Node = tuple[str, str, str, str, str | None]


def nodes(body: str | None, payloads: bool = True) -> list[Node]:
    """``variant, kind, path, parent, payload`` of every node of a body."""
    tree = Automaton(_parse(body)) if body else None
    if tree is None or not isinstance(tree.top, (list, dict)):
        return []
    top, kind_of_body = tree.top, tree.state(tree.top)
    variant = _VARIANTS.get(kind_of_body)
    out: list[Node] = []
    text = _json if payloads else lambda value: None

    def inner(owner: str, at: str, item: dict) -> None:
        """Rings and attributes of an object."""
        for member in _RINGS:
            if member in item:
                for i, ring in tree.rings(item[member]):
                    out.append((variant, "ring", f"{at}{member}[{i}]", owner, text({"role": member, "coordinates": ring})))
        for i, value in enumerate(_items(item.get("attributes"))):
            if value is not None and value != []:
                out.append((variant, "attribute", f"{at}attributes[{i}]", owner, text(value)))

    def records(stack: list[tuple[str, str, Any]], kind: str) -> None:
        """Objects of a kind, and the objects within them."""
        while stack:
            path, parent, item = stack.pop()
            if not isinstance(item, dict):
                continue
            out.append((variant, kind, path, parent, text({k: v for k, v in item.items() if k not in _OWN}) if payloads else None))
            inner(path, f"{path}.", item)
            for member in _CHILDREN:
                if member in item:
                    stack += [(f"{path}.{member}[{i}]", path, x) for i, x in enumerate(_items(item[member]))][::-1]

    if isinstance(top, list):
        if variant == "boxes":
            records([(f"[{i}]", "$", x) for i, x in enumerate(top)][::-1], "box")
        return out
    if kind_of_body == "box":
        records([("[0]", "$", top)], "box")
    elif kind_of_body not in _ROUTES:
        inner("$", "", {k: v for k, v in top.items() if k != "segmentation"})
    images: dict[str, str] = {}
    for member, kind in _ROUTES.get(kind_of_body, ()):
        for i, item in enumerate(_items(top.get(member))):
            if not isinstance(item, dict):
                continue
            path = f"{member}[{i}]"
            if kind in ("object", "box"):
                records([(path, "$", item)], kind)
            elif kind == "annotation":
                image = item.get("image_id")
                records([(path, images.get(_name(image), "") if image is not None else "", item)], kind)
            else:
                out.append((variant, kind, path, "$", text(item)))
                if kind == "image" and item.get("id") is not None:
                    images.setdefault(_name(item["id"]), path)
    return out


def flatten_annotations(df: DataFrame, id_col: str = "file_id", body_col: str = "body", payloads: bool = True) -> DataFrame:
    """All nodes of all bodies, one row each (a narrow map: no shuffle).

    Without ``payloads`` that column is NULL, and nothing is written again as JSON.
    """
    names = ["file_id", "variant", "node_kind", "node_path", "parent_path", "payload"]
    schema = pa.schema([("file_id", pa.int64()), *[(n, pa.string()) for n in names[1:]]])

    def batch_of(ids: list, sizes: list[int], rows: list[Node]) -> pa.RecordBatch:
        owner = pa.array([i for i, n in zip(ids, sizes) for _ in range(n)], pa.int64())
        return pa.RecordBatch.from_arrays([owner, *[pa.array([r[k] for r in rows], pa.string()) for k in range(5)]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, rows = [], [], []
            for file_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = nodes(body.as_py(), payloads)
                for begin in range(0, len(found), 50_000):  # a body may be longer than a batch should be
                    part = found[begin : begin + 50_000]
                    ids.append(file_id)
                    sizes.append(len(part))
                    rows += part
                    if len(rows) >= 50_000:
                        yield batch_of(ids, sizes, rows)
                        ids, sizes, rows = [], [], []
            yield batch_of(ids, sizes, rows)

    return df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(body_col).alias("_body")).where("_body is not null").mapInArrow(run, NODE_SCHEMA)


#: Typed columns of each kind's table, read from the payload.
_TYPED = {
    "image": "id string, file_name string, width int, height int, license string",
    "category": "id string, name string, supercategory string",
    "license": "id string, name string",
    "annotation": "id string, image_id string, category_id string, area double, iscrowd int, bbox array<double>",
    "object": "class int",
    "box": "class int, bbox string",
    "ring": "role string, coordinates string",
    "attribute": "name string, value string",
}

KINDS = list(_TYPED)


def node_table(flat: DataFrame, kind: str) -> DataFrame:
    """The typed table of one kind, with the columns that all kinds share."""
    typed = F.from_json("payload", T._parse_datatype_string(_TYPED[kind]))
    return flat.where(F.col("node_kind") == kind).select("file_id", "variant", "node_path", "parent_path", typed.alias("n")).select("file_id", "variant", "node_path", "parent_path", "n.*")
