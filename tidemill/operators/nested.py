"""Transform fields at any depth of structs and arrays, without exploding.

A path such as ``orders.items.price`` walks through structs and arrays alike; names match without
regard to case. The schema is walked once on the driver and becomes one expression per root column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import materialise


def _find(struct: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in struct.fields if f.name.lower() == name.lower()), None)


class _Scope:
    """Resolves a full path against the innermost enclosing struct that it starts with."""

    def __init__(self, levels: list[tuple[list[str], Column]]):
        self.levels = levels

    def __call__(self, path: str) -> Column:
        parts = path.split(".")
        for trail, col in reversed(self.levels):
            if len(trail) < len(parts) and [p.lower() for p in parts[:len(trail)]] == [t.lower() for t in trail]:
                for p in parts[len(trail):]:
                    col = col[p]
                return col
        return F.col(path)


def _each(col: Column, dtype: T.DataType, fn: Callable) -> Column:
    """Apply ``fn(element, type)`` below any number of array levels."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _each(x, dtype.elementType, fn))
    return fn(col, dtype)


def _edit(col: Column, dtype: T.DataType, parts: list[str], trail: list[str], levels: list, edit) -> Column:
    def inside(element, struct):
        if not isinstance(struct, T.StructType):
            raise ValueError(f"{'.'.join(trail)} is not a struct")
        here = levels + [(trail, element)]
        if len(parts) == 1:
            out = element
            for name, value in edit(lambda n: element[n], struct, _Scope(here)).items():
                out = out.dropFields(name) if value is None else out.withField(name, value)
            return out
        child = _find(struct, parts[0])
        if child is None:
            raise ValueError(f"no field {parts[0]} under {'.'.join(trail)}")
        return element.withField(child.name, _edit(element[child.name], child.dataType, parts[1:],
                                                   trail + [child.name], here, edit))
    return _each(col, dtype, inside)


def edit_nested(df: DataFrame, path: str, edit) -> DataFrame:
    """``edit(get, struct, scope)`` returns {field: new value, or None to drop} for the struct that
    holds the last part of ``path``."""
    parts = path.split(".")
    if len(parts) == 1:
        for name, value in edit(lambda n: F.col(n), df.schema, _Scope([])).items():
            df = df.drop(name) if value is None else df.withColumn(name, value)
        return df
    root = _find(df.schema, parts[0])
    if root is None:
        raise ValueError(f"no column {parts[0]}")
    return df.withColumn(root.name, _edit(F.col(root.name), root.dataType, parts[1:], [root.name], [], edit))


def add_nested(df: DataFrame, path: str, value: Column | Callable) -> DataFrame:
    """Add a field; ``value`` is a column, or a function of ``get_field`` that may read any enclosing level."""
    leaf = path.split(".")[-1]

    def edit(get, struct, scope):
        if _find(struct, leaf):
            raise ValueError(f"{path} exists already")
        return {leaf: value if isinstance(value, Column) else value(scope)}

    return edit_nested(df, path, edit)


def drop_nested(df: DataFrame, path: str) -> DataFrame:
    leaf = path.split(".")[-1]

    def edit(get, struct, scope):
        found = _find(struct, leaf)
        return {found.name: None} if found else {}

    return edit_nested(df, path, edit)


def map_nested(df: DataFrame, path: str, output: str, fn: Callable) -> DataFrame:
    """Write ``fn(field)`` beside or over the field; arrays of values are mapped element by element."""
    leaf, out = path.split(".")[-1], output.split(".")[-1]

    def edit(get, struct, scope):
        found = _find(struct, leaf)
        if found is None:
            raise ValueError(f"no field {path}")
        return {out: _each(get(found.name), found.dataType, lambda x, _: fn(x))}

    return edit_nested(df, path, edit)


def map_nested_struct(df: DataFrame, path: str, output: str, fn: Callable) -> DataFrame:
    """Add ``output`` to the struct at ``path``: ``fn(struct)`` or ``fn(struct, get_field)``."""
    path = path.removesuffix(".*").removesuffix("*")
    out = output.split(".")[-1]
    takes_scope = fn.__code__.co_argcount > 1

    def edit(get, struct, scope):
        element = F.struct(*[get(f.name).alias(f.name) for f in struct.fields])
        return {out: fn(element, scope) if takes_scope else fn(element)}

    return edit_nested(df, f"{path}.{out}" if path else out, edit)


def map_with_errors(df: DataFrame, path: str, output: str, fn: Callable, error: Callable,
                    errors: str = "errors") -> DataFrame:
    """Map a field and, beside it, test it with ``error(field)`` (null when fine). Errors of every
    depth end up, without duplicates, in one root array. With two arguments both functions also
    get ``get_field``."""
    leaf, out = path.split(".")[-1], output.split(".")[-1]
    extended = fn.__code__.co_argcount > 1

    def call(f, x, scope):
        return f(x, scope) if extended else f(x)

    def edit(get, struct, scope):
        found = _find(struct, leaf)
        value = get(found.name)
        return {out: _each(value, found.dataType, lambda x, _: call(fn, x, scope)),
                "_errors": F.array_compact(_values(_each(value, found.dataType,
                                                         lambda x, _: call(error, x, scope)),
                                                   found.dataType))}

    inner = ".".join(path.split(".")[:-1] + ["_errors"])
    return gather_errors(edit_nested(df, path, edit), inner, errors)


def _values(col: Column, dtype: T.DataType) -> Column:
    """A flat array of the mapped values, whatever the number of array levels."""
    if not isinstance(dtype, T.ArrayType):
        return F.array(col)
    while isinstance(dtype.elementType, T.ArrayType):
        col, dtype = F.flatten(col), dtype.elementType
    return col


def _collect(col: Column, dtype: T.DataType, parts: list[str]) -> Column:
    """All leaf array entries under ``col`` as one flat array."""
    if isinstance(dtype, T.ArrayType):
        if not parts and not isinstance(dtype.elementType, (T.ArrayType, T.StructType)):
            return F.coalesce(col, F.array().cast(T.ArrayType(dtype.elementType)))
        if not parts and isinstance(dtype.elementType, T.StructType):
            return F.coalesce(col, F.array().cast(dtype))
        return F.flatten(F.transform(F.coalesce(col, F.array().cast(dtype)),
                                     lambda x: _collect(x, dtype.elementType, parts)))
    field = _find(dtype, parts[0])
    return _collect(col[field.name], field.dataType, parts[1:])


def gather_errors(df: DataFrame, nested: str, errors: str) -> DataFrame:
    """Flatten a nested error array into the root array ``errors``: appended, without duplicates, at
    the place of an existing column. The nested column is dropped."""
    if "." in errors:
        raise ValueError("the error column must be at the root")
    parts = nested.split(".")
    root = _find(df.schema, parts[0])
    found = _collect(F.col(root.name), root.dataType, parts[1:])
    if errors in df.columns:
        found = F.concat(F.coalesce(F.col(errors), F.array().cast(df.schema[errors].dataType)), found)
    out = df.withColumn(errors, F.array_distinct(F.array_compact(found)))
    return drop_nested(out, nested) if nested != errors else out


def add_column_after(df: DataFrame, after: str, name: str, value: Column) -> DataFrame:
    columns = []
    for c in df.columns:
        columns.append(F.col(c))
        if c == after:
            columns.append(value.alias(name))
    return df.select(*columns)


def flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields at any depth as ``a_b_c`` columns; arrays stay."""
    def leaves(struct, path):
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path + [f.name])
            else:
                yield path + [f.name]
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
                       for path in leaves(df.schema, [])])


def deep_flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Flatten structs and explode arrays of structs until only plain columns and arrays of values remain."""
    while True:
        df = flatten_structs(df, sep)
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)
                  and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType))]
        if not arrays:
            return df
        df = df.withColumn(arrays[0], F.explode_outer(arrays[0]))


# -- documents as related frames ----------------------------------------------------------------

ROOT = ""


def _array_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]


def split_documents(df: DataFrame, sep: str = "_") -> dict[str, DataFrame]:
    """Documents as one frame for each array of structs at any depth: sibling arrays give as many rows as they have entries, not their product.

    The frame ``""`` has the flattened fields of the documents and ``_id``; the frame of an array, named by its path, has ``_id``, the ``_parent`` it lies in, its place
    ``_pos`` from 0 on, and its flattened fields; a null entry has null fields and ``_null`` set. ``join_documents`` puts them together again. Ids are generated once: the documents are written out with them."""
    rows = materialise(df.withColumn("_id", F.monotonically_increasing_id().cast("string")))
    out: dict[str, DataFrame] = {}

    def split(frame: DataFrame, name: str) -> None:
        flat = flatten_structs(frame, sep)
        arrays = _array_fields(flat.schema)
        out[name] = flat.drop(*arrays)
        for array in arrays:
            items = flat.select(F.col("_id").alias("_parent"), F.posexplode(array).alias("_pos", "_item"))
            items = items.select(F.concat_ws(".", "_parent", "_pos").alias("_id"), "_parent", "_pos", F.col("_item").isNull().alias("_null"), "_item.*")
            split(items, f"{name}{sep}{array}" if name else array)

    split(rows, ROOT)
    return out


def join_documents(frames: dict[str, DataFrame], sep: str = "_") -> DataFrame:
    """The documents of ``split_documents`` with flattened fields; arrays are lists of structs in their order. A document's array is gathered from its own entries alone.

    An empty array and a null one are told apart no more: both come back empty."""
    def rebuilt(name: str) -> DataFrame:
        df = frames[name]
        depth = {n: n.removeprefix(f"{name}{sep}") if name else n for n in frames if n and n != name and (not name or n.startswith(name + sep))}
        direct = [n for n in depth if not any(n != o and n.startswith(o + sep) for o in depth)]
        for child in direct:
            items = rebuilt(child)
            fields = [c for c in items.columns if c not in ("_id", "_parent", "_pos", "_null")]
            entry = F.when(~F.col("_null"), F.struct(*fields))
            lists = items.groupBy(F.col("_parent").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_pos", entry.alias("e")))).alias("_list"))
            kind = T.ArrayType(T.StructType([items.schema[c] for c in fields]))
            df = df.join(lists, df["_id"] == lists["_of"], "left").withColumn(
                depth[child], F.coalesce(F.transform("_list", lambda x: x["e"]), F.array().cast(kind))).drop("_of", "_list")
        return df
    return rebuilt(ROOT).drop("_id")
