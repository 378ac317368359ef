"""One schema of nested JSON texts: columnar shredding into levels, footers combined, maps collapsed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .common import discard, stored

#: Types of values, in the order in which they are spelled. ``bad`` is that of texts that are no whole object.
KINDS = ("array", "bad", "boolean", "double", "integer", "null", "object", "string")
ARRAY, BAD, OBJECT = KINDS.index("array"), KINDS.index("bad"), KINDS.index("object")
CODES = {list: ARRAY, bool: 2, float: 3, int: 4, type(None): 5, dict: OBJECT, str: 7}
#: Rows and bytes of text that are shredded at once, and paths that a task keeps footers of; with more it hands them on.
STEP_ROWS, STEP_BYTES, MOST_PATHS = 20_000, 8_000_000, 200_000
#: Steps of a path: the root, names with a dot before them, elements, and the names of a map.
ROOT, ELEMENT, ANY = "$", "[]", "*"
TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


def _refuse(text: str) -> None:
    raise ValueError(text)


#: Numbers count by their spelling, so that one of any length has a type; NaN and Infinity are no JSON.
_decode = json.JSONDecoder(parse_int=lambda s: 0, parse_float=lambda s: 0.0, parse_constant=_refuse).decode


def _decode_deep(text: str):
    """As the decoder, for texts nested deeper than it can follow: open containers are kept in a list."""
    at, state, value, names = 0, "value", None, []
    open_: list = []
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            break
        at = m.end()
        mark, string, number, word = m.groups()
        if state == "done":
            raise ValueError("text after the value")
        if mark == ":" and state == "colon":
            state = "value"
            continue
        if mark == "," and state == "next":
            state = "name" if isinstance(open_[-1], dict) else "value"
            continue
        if string is not None and state in ("name", "first name"):
            names[-1], state = json.loads(string), "colon"
            continue
        if mark in ("{", "[") and state in ("value", "first value"):
            new = {} if mark == "{" else []
            open_.append(new)
            names.append(None)
            state = "first name" if mark == "{" else "first value"
            continue
        if mark in ("}", "]") and open_ and state in ("next", "first name" if mark == "}" else "first value") and isinstance(open_[-1], dict) == (mark == "}"):
            value = open_.pop()
            names.pop()
        elif mark is None and state in ("value", "first value"):
            value = json.loads(string) if string is not None else 0 if number is not None and not set(number) & set(".eE") else 0.0 if number is not None else {"true": True, "false": False, "null": None}[word]
        else:
            raise ValueError("not JSON")
        if not open_:
            state = "done"
        else:
            if isinstance(open_[-1], dict):
                open_[-1][names[-1]] = value
            else:
                open_[-1].append(value)
            state = "next"
    if state != "done" or text[at:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return value


def whole_object(text: str | None) -> dict | None:
    """The object that ``text`` is as a whole; None for all others. Of a name that an object repeats the last value counts."""
    if text is None:
        return None
    try:
        try:
            value = _decode(text)
        except RecursionError:
            value = _decode_deep(text)
    except ValueError:
        return None
    return value if type(value) is dict else None


class Shredder:
    """Columns of levels by path, and the footers of all columns so far.

    An entry of a column is (type, repetition level, definition level). The repetition level
    says at which of the path's arrays the value continues, and 0 that a row begins; the
    definition level is the number of the path's steps that are there. Entries for names that
    an object lacks are not stored, as their number follows from the object's own column; an
    empty array has an entry in the column of its elements, one level short.
    """

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.paths: list[tuple[str, ...]] = []
        self.repeated: list[int] = []
        self.children: list[dict] = []
        self.roots: dict[str, int] = {}
        self.counts = np.zeros((0, len(KINDS)), np.int64)
        self.lengths = np.zeros((0, 2), np.int64)
        self.clear()

    def clear(self) -> None:
        self.at, self.kind, self.rep, self.deep = [], [], [], []

    def node(self, parent: int | None, step: str) -> int:
        step = step.encode("utf-8", "backslashreplace").decode()
        new = len(self.paths)
        self.paths.append((step,) if parent is None else (*self.paths[parent], step))
        self.repeated.append(0 if parent is None else self.repeated[parent] + (step == ELEMENT))
        self.children.append({})
        return new

    def root(self, step: str) -> int:
        if step not in self.roots:
            self.roots[step] = self.node(None, step)
        return self.roots[step]

    def entry(self, at: int, kind: int, rep: int, deep: int) -> None:
        self.at.append(at)
        self.kind.append(kind)
        self.rep.append(rep)
        self.deep.append(deep)

    def bad(self, step: str) -> None:
        self.entry(self.root(step), BAD, 0, 1)

    def add(self, value: object) -> None:
        """Shred one row's value below the root."""
        children, repeated, codes = self.children, self.repeated, CODES
        put_at, put_kind, put_rep, put_deep = self.at.append, self.kind.append, self.rep.append, self.deep.append
        todo = [(self.root(ROOT), value, 0, 1)]
        while todo:
            at, value, rep, deep = todo.pop()
            kind = codes[type(value)]
            put_at(at)
            put_kind(kind)
            put_rep(rep)
            put_deep(deep)
            if kind == OBJECT:
                known = children[at]
                for name, inner in value.items():
                    below = known.get(name)
                    if below is None:
                        below = known[name] = self.node(at, "." + name)
                    todo.append((below, inner, rep, deep + 1))
            elif kind == ARRAY:
                known = children[at]
                below = known.get(None)
                if below is None:
                    below = known[None] = self.node(at, ELEMENT)
                if value:
                    own = repeated[below]
                    # the list is worked off from its end: the first element, pushed last, comes first
                    todo.extend((below, inner, own, deep + 1) for inner in reversed(value[1:]))
                    todo.append((below, value[0], rep, deep + 1))
                else:
                    self.entry(below, -1, rep, deep)

    def fold(self) -> None:
        """Add the step's columns to the footers: values by type, and the lengths of arrays from the levels of their elements."""
        n = len(self.paths)
        if n > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros((n - len(self.counts), len(KINDS)), np.int64)])
            new = np.zeros((n - len(self.lengths), 2), np.int64)
            new[:, 0] = np.iinfo(np.int64).max
            new[:, 1] = -1
            self.lengths = np.concatenate([self.lengths, new])
        at, kind, rep, deep = (np.array(x, np.int64) for x in (self.at, self.kind, self.rep, self.deep))
        self.clear()
        depth = np.array([len(p) for p in self.paths], np.int64)
        there = deep == depth[at]
        self.counts += np.bincount(at[there] * len(KINDS) + kind[there], minlength=n * len(KINDS)).reshape(n, -1)
        elements = np.array([p[-1] == ELEMENT for p in self.paths], bool)
        of = np.flatnonzero(elements[at])
        if len(of):
            of = of[np.argsort(at[of], kind="stable")]
            column, level = at[of], np.array(self.repeated, np.int64)
            begins = np.flatnonzero(rep[of] < level[column])
            size = np.add.reduceat(there[of].astype(np.int64), begins)
            np.minimum.at(self.lengths[:, 0], column[begins], size)
            np.maximum.at(self.lengths[:, 1], column[begins], size)

    def footers(self) -> Iterator[dict[str, list]]:
        """The footers in parts; a length stands with the array's path."""
        of = {p: i for i, p in enumerate(self.paths)}
        low, high = np.full(len(self.paths), -1), np.full(len(self.paths), -1)
        for i, p in enumerate(self.paths):
            if p[-1] == ELEMENT and self.lengths[i, 1] >= 0:
                low[of[p[:-1]]], high[of[p[:-1]]] = self.lengths[i]
        for a in range(0, len(self.paths), 10_000):
            some = [i for i in range(a, min(a + 10_000, len(self.paths))) if self.counts[i].any()]
            out = {"path": [list(self.paths[i]) for i in some]} | {k: self.counts[some, j] for j, k in enumerate(KINDS)}
            yield out | {"min_len": [int(low[i]) if high[i] >= 0 else None for i in some], "max_len": [int(high[i]) if high[i] >= 0 else None for i in some]}


FOOTER = T.StructType([T.StructField("path", T.ArrayType(T.StringType()))] + [T.StructField(k, T.LongType()) for k in (*KINDS, "min_len", "max_len")])


def footers(rows: DataFrame) -> DataFrame:
    """Footers of (text, under, boxed, bad), one for each path and task or more; see infer_schema."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, shred = to_arrow_schema(FOOTER), Shredder()

        def given() -> Iterator[pa.RecordBatch]:
            for out in shred.footers():
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in to], schema=to)
            shred.reset()

        for batch in batches:
            size = max(1, min(STEP_ROWS, int(STEP_BYTES / max(1, batch.nbytes / max(1, batch.num_rows)))))
            for a in range(0, batch.num_rows, size):
                for text, under, boxed, bad in zip(*(batch.column(c).slice(a, size).to_pylist() for c in ("text", "under", "boxed", "bad")), strict=True):
                    value: object = whole_object(text)
                    if value is None:
                        shred.bad(bad or "!")
                        continue
                    value = [value] if boxed else value
                    for name in reversed(under or ()):
                        value = {name: value}
                    shred.add(value)
                shred.fold()
                if len(shred.paths) > MOST_PATHS:
                    yield from given()
        yield from given()

    return rows.mapInArrow(run, FOOTER)


def combined(parts: DataFrame) -> DataFrame:
    return parts.groupBy("path").agg(*[F.sum(k).alias(k) for k in KINDS], F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))


def spelled(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.when(s == ANY, F.lit("." + ANY)).otherwise(s)), "")


def infer_schema(df: DataFrame, text_col: str, under: Column | None = None, boxed: Column | None = None, bad: Column | None = None, most_names: int = 5) -> DataFrame:
    """(path, types, n_names, is_map, optional, min_len, max_len): the schema that all texts have in common.

    A text that is one whole JSON object counts with all its values: the object at ``$`` or,
    if ``under`` (array of names) says so, within as many enclosing objects, which count, too;
    with ``boxed`` the innermost of these holds an array of it. Other texts, null ones too,
    give a value of type ``bad`` at the path that ``bad`` says, ``!`` if it says none. Members
    add ``.name``, elements ``[]``. Where the objects of a path but ``$`` have more than
    ``most_names`` different names, they are a map and all its names become ``*``; from the top
    down, so that names below are counted after those above are replaced.

    ``types`` has the number of values by type; ``optional`` is true of a name that some of
    the objects above lack. Repeated rows count each time; an empty table gives no rows; other
    columns are ignored. Of names that an object repeats the last one counts. Steps are told
    apart as such: the name ``a.b`` and ``b`` within ``a`` are two paths, spelled alike.

    1. Each task shreds its rows into columns of levels and keeps a footer for each path:
       values by type, and the lengths of arrays from the levels of their elements.
    2. Footers of all tasks are summed by path, by as many tasks as there are partitions.
    3. From the top level that has maps down, names below each path are counted, and the
       footers of a map's names are summed. Nothing but these levels comes to the driver.
    """
    one = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    rows = df.select(F.col(text_col).alias("text"), one(under, "array<string>").alias("under"), one(boxed, "boolean").alias("boxed"), one(bad, "string").alias("bad"))
    paths = stored(combined(footers(rows)), "footers")
    counted, settled = [], 0
    while True:
        # names below each path; those of the paths down to the first level with maps are final
        named = paths.filter(F.element_at("path", -1).startswith("."))
        names = stored(named.groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("of")).agg(F.count(F.lit(1)).alias("n_names")), "names")
        maps = names.filter((F.col("n_names") > most_names) & (F.size("of") > 1))
        level = maps.agg(F.min(F.size("of"))).first()[0]
        counted.append(names.filter((F.size("of") > settled) & (F.lit(level is None) | (F.size("of") <= (level or 0)))))
        if level is None:
            break
        settled, above = level, F.slice("path", 1, level)
        found = paths.withColumn("at", F.when(F.get("path", F.lit(level)).startswith("."), above))
        found = found.join(maps.filter(F.size("of") == level).select("of", F.lit(True).alias("as_map")), F.col("at") == F.col("of"), "left")
        below = F.slice("path", F.lit(level + 2), F.greatest(F.size("path") - level - 1, F.lit(0)))
        new = stored(combined(found.withColumn("path", F.when(F.col("as_map"), F.concat(above, F.array(F.lit(ANY)), below)).otherwise(F.col("path")))), "footers")
        discard(paths)
        paths = new
    names = reduce(DataFrame.unionByName, counted)
    objects = paths.filter(F.col("object") > 0).select(F.col("path").alias("holder"), F.col("object").alias("holders"))
    parent = F.when(F.element_at("path", -1).startswith("."), F.slice("path", F.lit(1), F.size("path") - 1))
    found = paths.join(names, F.col("path") == F.col("of"), "left").withColumn("parent", parent).join(objects, F.col("parent") == F.col("holder"), "left")
    values = sum(F.col(k) for k in KINDS)
    types = F.array_join(F.filter(F.array(*[F.when(F.col(k) > 0, F.concat(F.lit(f"{k}:"), F.col(k))) for k in KINDS]), lambda x: x.isNotNull()), "|")
    n = F.coalesce("n_names", F.lit(0).cast("long"))
    return found.select(
        spelled(F.col("path")).alias("path"), types.alias("types"), n.alias("n_names"), ((n > most_names) & (F.col("path") != F.array(F.lit(ROOT)))).alias("is_map"),
        F.coalesce(values < F.col("holders"), F.lit(False)).alias("optional"), "min_len", "max_len",
    )
