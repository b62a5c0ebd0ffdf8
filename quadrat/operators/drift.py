"""Schemas that drift between the files of a series.

Every line is parsed as a variant in the JVM and exploded to (field, type).  Fields, types and shapes of
a file are pre-aggregated counts.  Between a file and its predecessor, the fields that
went and the fields that came are matched by similarity flooding: both files are graphs of
fields, their nested members, types and name parts; the first scores are the agreement of values over
the images that both files list, and likeness of names and types; scores flow along equally
labelled edges until they settle, and the best pairs by score, each field once, are the
correspondences.  A correspondence is a rename if its values agree (an exact check of what flooding
chose).  What is left came or went; fields that stay are compared by type.  Values are read in a
second pass, of moving fields only; no pass writes lines or values of others.

Cases and their result
----------------------
* NULL and broken lines are unreadable: they count nowhere.  A line that isn't an object too.
* A field belongs to a file if more than half of its readable lines carry the key (also with a
  null value).  Its type is that of most of its non-null values (ties: the first by name); a
  field with nothing but nulls has no type and is never retyped.
* A line sent twice counts twice; for the values of an image its smallest value text counts.
* A file without readable lines is no file.  The first file of a series changes nothing.
* Values are the same if their JSON is, or if both are the same number written otherwise, quoted
  or not.
* Columns beyond those named are not read.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators.grouped import Arrays, map_groups
from quadrat.session import cut, small, spread

CHANGE_SCHEMA = "series string, file_seq int, change_kind string, old_field string, new_field string"
#: Share of common images whose value must agree for a rename.
AGREE = 0.7


def _lines(df: DataFrame) -> DataFrame:
    lines = df.select("series", F.col("file_seq").cast("int").alias("file_seq"), F.try_parse_json("body").alias("doc"))
    return lines.where(F.schema_of_variant("doc").startswith("OBJECT"))


def _cells(lines: DataFrame) -> DataFrame:
    """One row per line and field: its type, and its shape if it is nested.

    ``starts`` marks one row of each line; a line without fields has just that.
    """
    view = lines.select("series", "file_seq", "doc")
    exploded = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("doc").outer()), how="left")
    raw = F.schema_of_variant("value")
    starts = F.coalesce(F.col("pos") == 0, F.lit(True))
    return exploded.select("series", "file_seq", F.col("key").alias("field"), _kind(F.col("value"), raw).alias("kind"), F.when(raw.rlike("^(ARRAY|OBJECT)"), raw).alias("shape"), starts.alias("starts"))


def _kind(value: Column, raw: Column) -> Column:
    """The type of a value, from its variant schema; NULL for null."""
    return (
        F.when(value.isNull() | (raw == "VOID"), F.lit(None))
        .when(raw == "BIGINT", "integer")
        .when(raw.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")  # too long for BIGINT; a shorter one was written like 1.0
        .when(raw.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "decimal")
        .when(raw == "STRING", "string")
        .when(raw == "BOOLEAN", "boolean")
        .when(raw.startswith("ARRAY"), "array")
        .when(raw.startswith("OBJECT"), "object")
    )


def field_counts(lines: DataFrame) -> DataFrame:
    """Values per file, field and type, written once: ``series, file_seq, field, kind, n, n_starts, shape``."""
    cells = _cells(lines)
    return cut(cells.groupBy("series", "file_seq", "field", "kind").agg(F.count("*").alias("n"), F.count_if("starts").alias("n_starts"), F.max("shape").alias("shape")))


def file_fields(counts: DataFrame) -> DataFrame:
    """Fields that belong to each file, with the number of its lines that carry them: ``series, file_seq, prev_seq, field, kind, shape, n``."""
    files = counts.groupBy("series", "file_seq").agg(F.sum("n_starts").alias("n_lines"))
    files = files.withColumn("prev_seq", F.lag("file_seq").over(W.partitionBy("series").orderBy("file_seq")))
    most = F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))
    fields = counts.where("field is not null").groupBy("series", "file_seq", "field").agg(F.sum("n").alias("n"), F.max_by("kind", most).alias("kind"), F.max_by("shape", most).alias("shape"))
    return fields.join(files, ["series", "file_seq"]).where("n * 2 > n_lines").select("series", "file_seq", "prev_seq", "field", "kind", "shape", "n")


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w]


Field = tuple[str, str | None] | tuple[str, str | None, str | None]
#: How much likeness of names and types, and what flows in, count beside the agreement of values (1).
NAMES, TYPES_ALIKE, FLOW = 0.2, 0.1, 0.2
_TOKEN = re.compile(r"([^<>:,]+):|([A-Z]+)|([<>])")


def _members(shape: str | None) -> list[tuple[int, str, str]]:
    """Nested members of a shape like ``ARRAY<OBJECT<a: BIGINT>>``: place of the owner (-1: the field), name and type."""
    out: list[tuple[int, str, str]] = []
    owners, last = [-1], -1
    for name, kind, mark in _TOKEN.findall(shape or ""):
        if name:
            out.append((owners[-1], name.strip(), ""))
            last = len(out) - 1
        elif kind:
            if last >= 0 and not out[last][2]:
                out[last] = (*out[last][:2], kind)
        elif mark == "<":
            owners.append(last if len(owners) > 1 or last >= 0 else -1)
        elif len(owners) > 1:
            last = owners.pop()
    return out


class _Graph:
    """A schema as labelled edges between nodes: fields first, then members, types and name parts."""

    def __init__(self, fields: list[Field]) -> None:
        self.names, self.sorts = [f[0] for f in fields], ["field"] * len(fields)
        self.edges: dict[str, list[tuple[int, int]]] = {}
        shared: dict[tuple[str, str], int] = {}

        def node(sort: str, name: str) -> int:
            if sort == "member" or (sort, name) not in shared:
                self.names.append(name)
                self.sorts.append(sort)
                shared[sort, name] = len(self.names) - 1
            return shared[sort, name]

        def describe(at: int, name: str, kind: str | None) -> None:
            self.edges.setdefault("type", []).append((at, node("type", kind or "none")))
            for word in _words(name):
                self.edges.setdefault("word", []).append((at, node("word", word)))

        for at, (name, kind, *shape) in enumerate(fields):
            describe(at, name, kind)
            places: list[int] = []
            for owner, member, member_kind in _members(shape[0] if shape else None):
                places.append(node("member", member))
                self.edges.setdefault("member", []).append((at if owner < 0 else places[owner], places[-1]))
                describe(places[-1], member, member_kind)

    def matrix(self, label: str) -> np.ndarray:
        out = np.zeros((len(self.names),) * 2)
        for a, b in self.edges.get(label, ()):
            out[a, b] = 1
        return out


def _equal_parts(m: np.ndarray) -> np.ndarray:
    """Each row shared out in equal parts."""
    return m / np.maximum(m.sum(1, keepdims=True), 1)


def flood(old: list[Field], new: list[Field], agree: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Scores of the pairs (old field, new field) after similarity flooding.

    ``agree`` holds the share of equal values.  A pair of nodes passes its score on, in equal parts, to the
    pairs that edges of one label lead to on both sides, and back; what flows in is added to the
    first scores, and all are scaled to 1, until they settle.
    """
    if not old or not new:
        return np.zeros((len(old), len(new)))
    a, b = _Graph(old), _Graph(new)
    n, m = len(old), len(new)
    like = np.array([[SequenceMatcher(None, x.lower(), y.lower()).ratio() if s == t else 0.0 for y, t in zip(b.names, b.sorts)] for x, s in zip(a.names, a.sorts)])
    types = np.array([[x == "type" and y == "type" for y in b.sorts] for x in a.sorts])
    equal = np.array([[x == y for y in b.names] for x in a.names])
    first = np.where(types, np.where(equal, 1.0, 0.0), like)
    alike = np.array([[1.0 if x[1] == y[1] else 0.0 for y in new] for x in old])
    first[:n, :m] = agree + NAMES * like[:n, :m] + TYPES_ALIKE * alike
    labels = sorted(set(a.edges) & set(b.edges))
    there = [(_equal_parts(a.matrix(k)), _equal_parts(b.matrix(k))) for k in labels]
    back = [(_equal_parts(a.matrix(k).T), _equal_parts(b.matrix(k).T)) for k in labels]
    score = first / max(first.max(), 1e-9)
    for _ in range(rounds):
        flow = sum((x.T @ score @ y for x, y in [*there, *back]), np.zeros_like(score))
        following = first + FLOW * flow
        following /= max(following.max(), 1e-9)
        still = np.abs(following - score).max() < 1e-6
        score = following
        if still:
            break
    return score[:n, :m]


def correspondences(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs by falling score, each row and column once."""
    score, pairs = score.copy(), []
    while score.size and score.max() > 0:
        i, j = np.unravel_index(score.argmax(), score.shape)
        pairs.append((int(i), int(j)))
        score[i, :] = -1
        score[:, j] = -1
    return pairs


def match_fields(old: list[Field], new: list[Field], shares: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Renames: the correspondences that flooding finds whose values agree."""
    agree = np.array([[shares.get((a[0], b[0]), 0.0) for b in new] for a in old]).reshape(len(old), len(new))
    return [(old[i][0], new[j][0]) for i, j in correspondences(flood(old, new, agree)) if agree[i, j] >= AGREE]


def schema_changes(df: DataFrame) -> DataFrame:
    """Changes of each file against its predecessor, from ``series, file_seq, body`` lines."""
    lines = _lines(df)
    return _changes(lines, cut(file_fields(field_counts(lines))))


def _changes(lines: DataFrame, fields: DataFrame) -> DataFrame:
    now = fields.where("prev_seq is not null").select("series", "file_seq", F.col("prev_seq"), "field", "kind", "shape")
    links = fields.where("prev_seq is not null").select("series", "file_seq", "prev_seq").distinct()
    before = fields.select("series", F.col("file_seq").alias("prev_seq"), "field", F.col("kind").alias("old_kind"), F.col("shape").alias("old_shape")).join(links, ["series", "prev_seq"])
    old_keys = before.select("series", "file_seq", "prev_seq", "field", "old_kind", "old_shape", F.lit(True).alias("in_old"))
    new_keys = now.select("series", "file_seq", "prev_seq", "field", F.col("kind").alias("new_kind"), F.col("shape").alias("new_shape"), F.lit(True).alias("in_new"))
    both = cut(old_keys.join(new_keys, ["series", "file_seq", "prev_seq", "field"], "full").where("field <> 'image'"))
    gone = both.where("in_new is null")
    came = both.where("in_old is null")

    # Values of the fields that come or go, by image.  Two rows per file list its moving fields.
    mover = lambda old: F.struct(F.col("file_seq").alias("pair_seq"), F.lit(old).alias("old"), "field")
    moving = gone.select("series", F.col("prev_seq").alias("file_seq"), mover(True).alias("m")).unionByName(came.select("series", "file_seq", mover(False).alias("m")))
    moving = cut(moving.groupBy("series", "file_seq").agg(F.collect_list("m").alias("moving")))
    held = lines.select("series", "file_seq", "doc", F.try_variant_get("doc", "$.image", "string").alias("image")).where("image is not null").join(small(moving), ["series", "file_seq"])
    held = held.select("series", "image", F.expr("cast(doc as map<string,variant>)").alias("members"), F.explode("moving").alias("m"))
    value = F.try_element_at("members", F.col("m.field"))
    text = F.regexp_replace(F.to_json("value"), '^"|"$', "")
    plain = F.coalesce(text.try_cast("double").cast("string"), text)
    held = held.select("series", F.col("m.pair_seq").alias("file_seq"), "image", "m.old", "m.field", value.alias("value")).where(F.col("value").isNotNull() & (F.schema_of_variant("value") != "VOID"))
    image = ["series", "file_seq", "image"]
    # one exchange by image serves both aggregations
    values = spread(held.select(*image, "old", "field", plain.alias("v")), *image).groupBy(*image, "old", "field").agg(F.min("v").alias("v"))
    per_image = values.groupBy(*image).agg(F.collect_list(F.struct("old", "field", "v")).alias("s"))
    side = lambda old: F.filter("s", lambda x: x["old"] if old else ~x["old"])
    pairs = per_image.select("series", "file_seq", side(True).alias("a"), side(False).alias("b")).where("size(a) > 0 and size(b) > 0")
    pairs = pairs.select("series", "file_seq", F.explode("a").alias("a"), "b").select("series", "file_seq", "a", F.explode("b").alias("b"))
    pairs = pairs.groupBy("series", "file_seq", F.col("a.field").alias("old_field"), F.col("b.field").alias("new_field")).agg(F.avg((F.col("a.v") == F.col("b.v")).cast("double")).alias("share"))

    blank = F.lit(None).cast("string")
    sides = lambda old, kind, shape, new, new_kind, new_shape, share: ["series", "file_seq", old.alias("old_field"), kind.alias("old_kind"), shape.alias("old_shape"), new.alias("new_field"), new_kind.alias("new_kind"), new_shape.alias("new_shape"), share.alias("share")]
    unknown = F.lit(None).cast("double")
    work = (
        gone.select(*sides(F.col("field"), F.col("old_kind"), F.col("old_shape"), blank, blank, blank, unknown))
        .unionByName(came.select(*sides(blank, blank, blank, F.col("field"), F.col("new_kind"), F.col("new_shape"), unknown)))
        .unionByName(pairs.select(*sides(F.col("old_field"), blank, blank, F.col("new_field"), blank, blank, F.col("share"))))
    )

    def decide(part: Arrays) -> Arrays:
        rows = list(zip(part["old_field"], part["old_kind"], part["old_shape"], part["new_field"], part["new_kind"], part["new_shape"], part["share"]))
        shares = {(o, n): x for o, _, _, n, _, _, x in rows if o is not None and n is not None}
        old = sorted({(o, k, s) for o, k, s, n, *_ in rows if n is None}, key=str)
        new = sorted({(n, k, s) for o, _, _, n, k, s, _ in rows if o is None}, key=str)
        renames = match_fields(old, new, shares)
        a, b = {x for x, _ in renames}, {y for _, y in renames}
        kinds_old, kinds_new = {x: k for x, k, _ in old}, {y: k for y, k, _ in new}
        out = [("renamed", x, y) for x, y in renames]
        out += [("removed", x, "") for x in kinds_old if x not in a]
        out += [("added", "", y) for y in kinds_new if y not in b]
        out += [("retyped", x, y) for x, y in renames if kinds_old[x] and kinds_new[y] and kinds_old[x] != kinds_new[y]]
        found = {"series": np.repeat(part["series"][:1], len(out)), "file_seq": np.repeat(part["file_seq"][:1], len(out))}
        return found | {name: np.array([row[k] for row in out], object) for k, name in enumerate(("change_kind", "old_field", "new_field"))}

    keyed = work.withColumn("pair", F.concat_ws("\x00", F.col("file_seq").cast("string"), "series"))
    moved = map_groups(keyed, "pair", [], decide, CHANGE_SCHEMA)
    retyped = both.where("in_old and in_new and old_kind <> new_kind").select("series", "file_seq", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    return moved.unionByName(retyped)


#: Column types of the kinds of value.
TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "string": "string", "array": "array<string>", "object": "map<string,string>"}


def common_kinds(counts: list[tuple[str, str | None, int]]) -> dict[str, str]:
    """The common kind of each field from (field, kind, values).

    Integers and decimals count together and give decimals; else the kind of most values wins
    (ties: the first by name).  A field with nothing but nulls is a string.
    """
    votes: dict[str, dict[str, int]] = {}
    for field, kind, n in counts:
        own = votes.setdefault(field, {})
        if kind is not None:
            own[kind] = own.get(kind, 0) + n
    kinds = {}
    for field, own in sorted(votes.items()):
        number = "decimal" if "decimal" in own else "integer"
        pooled: dict[str, int] = {}
        for kind, n in own.items():
            key = number if kind in ("integer", "decimal") else kind
            pooled[key] = pooled.get(key, 0) + n
        kinds[field] = min(pooled, key=lambda k: (-pooled[k], k), default="string")
    return kinds


def column_names(fields: list[str], taken: list[str]) -> list[str]:
    """A column name for each field; names that differ in case only, or are taken, get a number."""
    reserved, names = {x.lower() for x in (*taken, *fields)}, []
    seen = {t.lower() for t in taken}
    for field in fields:
        name, k = field or "_", 2
        while name.lower() in seen:
            name = f"{field or '_'}_{k}" if f"{field or '_'}_{k}".lower() not in reserved else name
            k += 1
        seen.add(name.lower())
        names.append(name)
    return names


def _cast_text(text: Column, nested: Column, kind: str) -> Column:
    """``text`` as a value of ``kind``; NULL if it is none."""
    if kind == "integer":
        return F.when(text.rlike(r"^\s*[-+]?\d+(\.0*)?\s*$"), F.regexp_replace(F.trim(text), r"\.0*$", "").try_cast("bigint"))
    if kind == "decimal":
        return F.when(text.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), text.try_cast("double"))
    if kind == "boolean":
        return text.try_cast("boolean")
    if kind == "string":
        return F.when(~nested, text)
    return F.when(text.rlike(r"^\s*\[" if kind == "array" else r"^\s*\{"), F.from_json(text, TYPES[kind]))


def unified_records(df: DataFrame) -> DataFrame:
    """Every readable line under one schema: ``record_id, series, file_seq, image, fields, uncast`` and a typed column per field.

    A field carries the name it had when it first appeared in its series (renames are followed
    file by file).  Each field that belongs to some file has a column of the common type of its
    values in all files, to which every value is cast.  ``fields`` maps the names to the values'
    JSON text, numbers and quoted numbers written alike; ``uncast`` holds the part of it that no
    column has: values that aren't of the common type, and fields of single records.  Columns
    whose names differ in case only are numbered.  Unreadable lines come out with NULL ``image``,
    ``fields``, ``uncast`` and columns.
    """
    parsed = _lines(df)
    belongs = cut(file_fields(field_counts(parsed)))
    changes = _changes(parsed, belongs).where("change_kind = 'renamed'").select("series", "file_seq", "old_field", "new_field")

    def chains(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first: dict[str, str] = {}
        rows = []
        for seq, group in part.sort_values("file_seq").groupby("file_seq", sort=True):
            moved = {new: first.get(old, old) for old, new in zip(group["old_field"], group["new_field"])}
            for old in group["old_field"]:
                first.pop(old, None)
            first |= moved
            rows.append((key[0], int(seq), {k: v for k, v in first.items() if k != v}))
        return pd.DataFrame(rows, columns=["series", "from_seq", "names"])

    names = changes.groupBy("series").applyInPandas(chains, "series string, from_seq int, names map<string,string>")
    files = df.select("series", F.col("file_seq").cast("int").alias("file_seq")).distinct()
    known = cut(files.join(names, "series").where("from_seq <= file_seq").groupBy("series", "file_seq").agg(F.max_by("names", "from_seq").alias("names")))
    called = lambda key: F.coalesce(F.try_element_at("names", key), key)
    counts = belongs.join(known, ["series", "file_seq"], "left").select(called(F.col("field")).alias("field"), "kind", "n").where("field <> 'image'")
    kinds = common_kinds([(r["field"], r["kind"], r["n"]) for r in counts.groupBy("field", "kind").agg(F.sum("n").alias("n")).collect()])
    lines = df.select("record_id", "series", F.col("file_seq").cast("int").alias("file_seq"), F.try_parse_json("body").alias("doc"))
    lines = lines.withColumn("doc", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.col("doc")))
    raw = F.from_json(F.to_json("doc"), "map<string,string>")
    nested = F.expr("map_keys(map_filter(cast(doc as map<string,variant>), (k, v) -> schema_of_variant(v) rlike '^(ARRAY|OBJECT)'))")
    lines = lines.select(
        "record_id",
        "series",
        "file_seq",
        F.try_variant_get("doc", "$.image", "string").alias("image"),
        F.map_filter(raw, lambda k, v: k != "image").alias("raw"),
        nested.alias("nested"),
    )
    joined = lines.join(known, ["series", "file_seq"], "left")
    renamed = F.map_from_entries(F.array_sort(F.transform(F.map_entries("raw"), lambda e: F.struct(called(e["key"]).alias("key"), e["value"].alias("value")))))
    head = ["record_id", "series", "file_seq", "image", "fields"]
    joined = joined.select(
        *head[:-1],
        F.when(F.col("names").isNull(), F.col("raw")).otherwise(renamed).alias("fields"),
        F.transform("nested", called).alias("nested"),
    )
    typed = [_cast_text(F.try_element_at("fields", F.lit(f)), F.array_contains("nested", f), kind).alias(f"_{k}") for k, (f, kind) in enumerate(kinds.items())]
    cast = joined.select(*head, *typed)
    held = F.array_compact(F.array(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(f)) for k, f in enumerate(kinds)])) if kinds else F.array().cast("array<string>")
    uncast = F.map_filter("fields", lambda k, v: v.isNotNull() & ~F.array_contains("_held", k))
    columns = [F.col(f"_{k}").alias(name) for k, name in enumerate(column_names(list(kinds), [*head, "uncast"]))]
    return cast.withColumn("_held", held).select(*head, uncast.alias("uncast"), *columns)
