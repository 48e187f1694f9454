"""Vectorized Python functions on cycles, intervals and windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Function:
    """A Python function and its type(s). arg_type "pandas": Series, or a DataFrame for several columns; "numpy": arrays."""

    fn: Callable
    types: tuple[T.DataType, ...]
    many: bool
    arg_type: str

    def __call__(self, *columns) -> Bound:
        for c in columns:
            if not isinstance(c, (str, list, tuple)) and not hasattr(c, "columns"):
                raise TypeError("arguments are column names, or lists of them")
        return Bound(self, tuple(c if isinstance(c, str) else tuple(getattr(c, "columns", c)) for c in columns))


@dataclass(frozen=True)
class Bound:
    function: Function
    arguments: tuple

    @property
    def needs(self) -> list[str]:
        return [c for a in self.arguments for c in ([a] if isinstance(a, str) else a)]

    def call(self, rows: pd.DataFrame):
        if self.function.arg_type == "numpy":
            given = [rows[a].to_numpy() if isinstance(a, str) else [rows[c].to_numpy() for c in a] for a in self.arguments]
        else:
            given = [rows[a] if isinstance(a, str) else rows[list(a)] for a in self.arguments]
        return self.function.fn(*given)


def _type(t) -> T.DataType:
    return t if isinstance(t, T.DataType) else T._parse_datatype_string(t)


def udf(return_type="double", arg_type: str = "pandas"):
    """A decorator. return_type: a type, or a tuple of types for several outputs."""
    if arg_type not in ("pandas", "numpy"):
        raise ValueError("arg_type: pandas or numpy")

    def made(fn, types=return_type):
        many = isinstance(types, (tuple, list))
        return Function(fn, tuple(_type(t) for t in (types if many else (types,))), many, arg_type)

    return made(return_type, "double") if callable(return_type) else made


def outputs_of(columns: dict) -> list[tuple[tuple[str, ...], Bound]]:
    """{name or tuple of names: bound function} as pairs; checked."""
    out = []
    for names, bound in columns.items():
        names = names if isinstance(names, tuple) else (names,)
        if not isinstance(bound, Bound):
            raise TypeError(f"{names}: expected a function made by udf() and applied to columns")
        if len(names) != len(bound.function.types):
            raise ValueError(f"{names}: the function gives {len(bound.function.types)} columns")
        out.append((names, bound))
    return out


def _fields(found) -> list[T.StructField]:
    return [T.StructField(n, t) for names, b in found for n, t in zip(names, b.function.types, strict=True)]


GROUP = "__group"


def _dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups dealt into a bounded number of packs, since a call for each small group costs more than its work."""
    packs = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(GROUP, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(packs)).cast("int"))


def _each(rows: pd.DataFrame, by: list[str], order: list[str]):
    rows = _ordered(rows.drop(columns=GROUP), order)
    for _, group in rows.groupby(by, dropna=False, sort=False):
        yield group.reset_index(drop=True)


def _ordered(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    return rows.sort_values(order, kind="stable") if order else rows


def aggregate(df: DataFrame, by: list[str], columns: dict, order: list[str]) -> DataFrame:
    """by, then one value (or tuple of values) of each function per group."""
    found = outputs_of(columns)
    schema = T.StructType([*[df.schema[c] for c in by], *_fields(found)])
    needs = list(dict.fromkeys([*by, *order, *[c for _, b in found for c in b.needs]]))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for group in _each(rows, by, order):
            out = {c: group[c].iloc[0] for c in by}
            for names, b in found:
                values = b.call(group)
                out |= dict(zip(names, values if b.function.many else (values,), strict=True))
            made.append(out)
        return pd.DataFrame(made, columns=schema.names)

    return _dealt(df.select(*[F.col(f"`{c}`") for c in needs]), by).groupBy(GROUP).applyInPandas(pack, schema)


def append(df: DataFrame, by: list[str], columns: dict, order: list[str]) -> DataFrame:
    """Every row with a value from its whole group: a Series (or tuple of Series) as long as the group."""
    found = outputs_of(columns)
    schema = T.StructType([*df.schema.fields, *_fields(found)])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for group in _each(rows, by, order):
            new = {}
            for names, b in found:
                values = b.call(group)
                for n, v in zip(names, values if b.function.many else (values,), strict=True):
                    if len(v) != len(group):
                        raise ValueError(f"{n}: {len(v)} values for {len(group)} rows")
                    new[n] = np.asarray(v)
            made.append(group.assign(**new))
        return pd.concat(made)[schema.names]

    return _dealt(df, by).groupBy(GROUP).applyInPandas(pack, schema)


def append_from_rows(df: DataFrame, by: list[str], columns: dict, order: list[str]) -> DataFrame:
    """Row form: name -> (type, fn(list of row dicts) -> {position: value}); missing positions give null."""
    fields = [T.StructField(n, _type(t)) for n, (t, _) in columns.items()]
    schema = T.StructType([*df.schema.fields, *fields])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for group in _each(rows, by, order):
            records, new = group.to_dict("records"), {}
            for n, (_, fn) in columns.items():
                values = fn(records)
                listed = list(values) if not isinstance(values, dict) else [values.get(i) for i in range(len(records))]
                new[n] = [*listed, *[None] * (len(records) - len(listed))]
            made.append(group.assign(**new))
        return pd.concat(made)[schema.names]

    return _dealt(df, by).groupBy(GROUP).applyInPandas(pack, schema)


def windowed(df: DataFrame, by: list[str], ticks: str, own: str, low: int, high: int, columns: dict, drop: list[str], order: list[str]) -> DataFrame:
    """Every own row with a value from the rows of its group whose ticks lie in [t + low, t + high]."""
    found = outputs_of(columns)
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *_fields(found)])

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ticks, *order], kind="stable").reset_index(drop=True)
        t = rows[ticks].to_numpy()
        mine = np.flatnonzero(rows[own].to_numpy())
        begins, ends = np.searchsorted(t, t[mine] + low, "left"), np.searchsorted(t, t[mine] + high, "right")
        out = rows.iloc[mine][[f.name for f in kept]].reset_index(drop=True)
        for names, b in found:
            values = [b.call(rows.iloc[i:j]) for i, j in zip(begins, ends, strict=True)]
            for k, n in enumerate(names):
                out[n] = [v[k] for v in values] if b.function.many else values
        return out

    return df.groupBy(*by).applyInPandas(group, schema)


BATCH = 20_000  # own rows of several small groups in one call


def window_batches(df: DataFrame, by: list[str], ticks: str, own: str, low: int, high: int, fn: Callable, fields: list[T.StructField], drop: list[str], order: list[str], most: int) -> DataFrame:
    """fn(left rows, right rows, begins, ends) for batches of at most `most` own rows and the rows that cover their windows:
    row i of left has the rows begins[i] to ends[i] - 1 of right. It gives a value (or tuple of values) per left row.
    A batch may hold several groups, as a call for each small group costs more than its work."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *fields])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(**{GROUP: rows.groupby(by, dropna=False, sort=False).ngroup()})
        rows = rows.sort_values([GROUP, ticks, *order], kind="stable").reset_index(drop=True)
        t, names, made = rows[ticks].to_numpy(), [f.name for f in kept], []
        edges = np.flatnonzero(np.diff(rows[GROUP].to_numpy(), prepend=-1, append=-1))
        mine = np.flatnonzero(rows[own].to_numpy())
        begins, ends, cuts = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64), [0]
        places = np.searchsorted(mine, edges)
        for i, j, a, b in zip(edges, edges[1:], places, places[1:], strict=False):
            some, at = t[i:j], t[mine[a:b]]
            begins[a:b], ends[a:b] = i + np.searchsorted(some, at + low, "left"), i + np.searchsorted(some, at + high, "right")
            if b - cuts[-1] > min(BATCH, most) and a > cuts[-1]:
                cuts.append(a)
            while b - cuts[-1] > most:
                cuts.append(cuts[-1] + most)
        for i, j in zip(cuts, [*cuts[1:], len(mine)], strict=True):
            if i == j:
                continue
            a, b = begins[i:j], ends[i:j]
            left = rows.iloc[mine[i:j]][names].reset_index(drop=True)
            values = fn(left, rows.iloc[a[0] : b[-1]][names].reset_index(drop=True), a - a[0], b - a[0])
            values = values if len(fields) > 1 else (values,)
            made.append(left.assign(**{f.name: np.asarray(v) for f, v in zip(fields, values, strict=True)}))
        return pd.concat(made) if made else rows.iloc[:0].reindex(columns=schema.names)

    return _dealt(df, by).groupBy(GROUP).applyInPandas(pack, schema)


def arrow_file(rows):
    """array<struct> as the bytes of an Arrow file, made from Arrow's own arrays, one group at a time."""

    @F.arrow_udf("binary")
    def encoded(lists: pa.Array) -> pa.Array:
        def one(records) -> bytes:
            sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_struct_array(records)
            with pa.ipc.new_file(sink, batch.schema) as writer:
                writer.write_batch(batch)
            return sink.getvalue().to_pybytes()

        return pa.array([one(x.values) for x in lists], pa.binary())

    return encoded(rows)
