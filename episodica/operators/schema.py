"""Modalities of step tables: nested fields as ``/`` paths, their kinds, and projections by kind."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions.names import kind_of_name, utf8_or_null

#: Leaves that windows leave out, and columns that only keep books.
UNWINDOWED = ("done", "terminated")
UNWINDOWED_PREFIXES = ("next/", "collector/")
BOOKKEEPING = ("episode_id", "step", "ep_len", "flat_index")
KINDS = ("image", "text", "state", "action")


@dataclass(frozen=True)
class ModalitySpec:
    """One leaf of a schema."""

    path: str
    kind: str
    dtype: str
    shape: tuple[int, ...]
    source: str


def leaf_fields(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.StructField]]:
    """All leaves with their ``/`` paths, in order of the schema."""
    for field in schema:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            yield from leaf_fields(field.dataType, f"{path}/")
        else:
            yield path, field


def leaf_column(path: str) -> Column:
    """The column of a ``/`` path."""
    return F.col(".".join(f"`{p}`" for p in path.split("/")))


def is_text(kind: T.DataType) -> bool:
    """Strings and arrays of strings."""
    return isinstance(kind, T.StringType) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType))


def specs(df: DataFrame, source: str = "storage") -> list[ModalitySpec]:
    """Specs of all leaves. A tensor's shape is the metadata ``shape`` of its field."""
    out = []
    for path, field in leaf_fields(df.schema):
        if path in BOOKKEEPING:
            continue
        shape = tuple(field.metadata.get("shape", ()))
        kind = kind_of_name(path)
        if kind == "generic":
            kind = "text" if is_text(field.dataType) else "image" if len(shape) >= 3 else kind
        elif len(shape) == 3 and shape[-1] in (1, 3, 4):
            kind = "image"
        elif is_text(field.dataType):
            kind = "text"
        dtype = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
        out.append(ModalitySpec(path, kind, dtype.simpleString(), shape, source))
    return out


def grouped(found: list[ModalitySpec]) -> dict[str, list[str]]:
    """Sorted paths by kind, for the kinds that samplers know."""
    return {k: sorted(s.path for s in found if s.kind == k) for k in KINDS if any(s.kind == k for s in found)}


def window_leaves(df: DataFrame) -> list[str]:
    """Leaves that get a window by default: all but text, flags, ``next/`` and ``collector/``."""
    return [
        p for p, f in leaf_fields(df.schema) if not is_text(f.dataType) and p not in (*UNWINDOWED, *BOOKKEEPING) and not p.startswith(UNWINDOWED_PREFIXES)
    ]


def _listed(field: T.StructField, value: Column, path: str) -> Iterator[tuple[str, Column]]:
    """Leaves of a value with their paths; the items of a list of known length are numbered segments."""
    length = field.metadata.get("items")
    if isinstance(field.dataType, T.StructType):
        for inner in field.dataType:
            yield from _listed(inner, value.getField(inner.name), f"{path}/{inner.name}")
    elif isinstance(field.dataType, T.ArrayType) and length is not None:
        for k in range(length):
            item = T.StructField(str(k), field.dataType.elementType, True, {})
            yield from _listed(item, F.get(value, F.lit(k)), f"{path}/{k}")
    else:
        yield path, value


def flattened(df: DataFrame) -> DataFrame:
    """Every leaf as a column named by its path.

    An array whose field has the metadata ``items``, a number, is a list of so many values rather than a tensor: each of
    them is a segment of the path by its place, and what is nested in it has paths of its own; places it lacks are null.
    """
    found = [leaf for f in df.schema for leaf in _listed(f, F.col(f"`{f.name}`"), f.name)]
    return df.select(*[value.alias(path) for path, value in found])


def nested(df: DataFrame, separator: str = ".") -> DataFrame:
    """Columns with separators in their names as structs."""

    def build(entries: list[tuple[list[str], str]]) -> list[Column]:
        heads = dict.fromkeys(path[0] for path, _ in entries)
        made = []
        for head in heads:
            own = [(path[1:], name) for path, name in entries if path[0] == head]
            made.append((F.col(f"`{own[0][1]}`") if own[0][0] == [] else F.struct(*build(own))).alias(head))
        return made

    return df.select(*build([(c.split(separator), c) for c in df.columns]))


def without_text(df: DataFrame) -> DataFrame:
    """All leaves but text; structs are kept with what is left of them."""

    def kept(schema: T.StructType, prefix: str) -> list[Column]:
        out = []
        for field in schema:
            path = f"{prefix}`{field.name}`"
            if isinstance(field.dataType, T.StructType):
                if inner := kept(field.dataType, f"{path}."):
                    out.append(F.struct(*inner).alias(field.name))
            elif not is_text(field.dataType):
                out.append(F.col(path).alias(field.name))
        return out

    return df.select(*kept(df.schema, ""))


def decoded(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bytes as text where they are UTF-8: the given binary columns, or those whose names say that they are text.

    A column has one type, so bytes that are no UTF-8 go to ``<column>_bytes``, and the text is null there.
    """
    chosen = [f.name for f in df.schema if isinstance(f.dataType, T.BinaryType) and (kind_of_name(f.name) == "text" if columns is None else f.name in columns)]
    given = {c: utf8_or_null(F.col(f"`{c}`")) for c in chosen}
    left = {f"{c}_bytes": F.when(given[c].isNull(), F.col(f"`{c}`")) for c in chosen}
    return df.select(*[given[c].alias(c) if c in given else F.col(f"`{c}`") for c in df.columns], *[v.alias(c) for c, v in left.items()])


def require_leaf(df: DataFrame, path: str) -> Column:
    """The column of a path, or an error that lists what there is."""
    known = [p for p, _ in leaf_fields(df.schema)]
    if path not in known:
        raise KeyError(f"{path} is not among {', '.join(known)}")
    return leaf_column(path)
