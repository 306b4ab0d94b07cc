"""Aggregates over a view's feature tables (mol_id, pos, idx, value), with NumPy's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import npsem
from .errors import FeatureOperationError


def _nan_min(c: Column) -> Column:
    return F.when(F.coalesce(F.bool_or(F.isnan(c.cast("double"))), F.lit(False)), float("nan")).otherwise(F.min(c.cast("double")))


REDUCERS = {
    "mean": lambda c: F.coalesce(F.avg(c), F.lit(float("nan"))),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "min": _nan_min,
    "max": lambda c: F.max(c.cast("double")),
    "add": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "multiply": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "maximum": lambda c: F.max(c.cast("double")),
    "minimum": _nan_min,
    "logical_and": lambda c: F.coalesce(F.bool_and(c), F.lit(True)),
    "logical_or": lambda c: F.coalesce(F.bool_or(c), F.lit(False)),
    "bitwise_and": F.bit_and,
    "bitwise_or": F.bit_or,
    "bitwise_xor": F.bit_xor,
}


#: Reducers that can run over a window.
RUNNING = {"add": F.sum, "multiply": F.product, "maximum": F.max, "minimum": F.min, "logical_and": F.bool_and, "logical_or": F.bool_or, "bitwise_and": F.bit_and, "bitwise_or": F.bit_or, "bitwise_xor": F.bit_xor}


#: The same for whole numbers, which keep their type.
WHOLE = {"min": F.min, "max": F.max, "minimum": F.min, "maximum": F.max}


def _element(df: DataFrame) -> T.DataType:
    kind = df.schema["value"].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def aggregate(df: DataFrame, how: str, axis: int | None = None, where: Column | None = None, initial: float | None = None, by: list[str] | None = None, keepdims: bool = False, width: int | None = None) -> DataFrame:
    """Reduce a feature to ``result``, over all elements (axis None), over nodes (0) or in each node (1).

    Scalar features take axis None or 0.  For arrays, axis 0 gives an array over components; with their ``width`` it is one
    aggregate of that many columns, otherwise components are exploded.  An empty min or max raises when read.
    """
    kind = _element(df)
    function = WHOLE.get(how, REDUCERS[how]) if isinstance(kind, T.IntegralType) else REDUCERS[how]
    if isinstance(kind, T.FloatType) and how in ("sum", "add", "mean", "multiply", "min", "max", "minimum", "maximum"):
        function = lambda c, wide=function: wide(c).cast("float")
    if where is not None:
        df = df.where(where)
    vector = df.schema["value"].dataType.typeName() == "array"
    groups = by or []

    def close(c: Column) -> Column:
        if initial is not None:
            c = {"sum": c + initial, "add": c + initial, "multiply": c * initial, "min": F.least(c, F.lit(float(initial))), "max": F.greatest(c, F.lit(float(initial)))}[how]
        elif how in ("min", "max", "minimum", "maximum"):
            c = F.coalesce(c, F.raise_error(F.lit(f"{how} of no elements")).cast(kind if isinstance(kind, (T.IntegralType, T.FloatType)) else "double"))
        return F.array(c) if keepdims else c

    if axis == 1:
        if not vector:
            raise FeatureOperationError("axis 1 needs several values a node")
        v = F.col("value")
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        nan = F.exists(v, lambda x: F.isnan(x))
        rows = {"sum": total, "mean": total / F.nullif(F.size(v), F.lit(0)), "max": F.array_max(v), "min": F.when(nan, float("nan")).otherwise(F.array_min(v))}
        return df.select(*[c for c in df.columns if c != "value"], rows[how].alias("result"))
    if not vector:
        return df.groupBy(*groups).agg(close(function(F.col("value"))).alias("result"))
    if axis is None:
        return df.select(*groups, F.explode("value").alias("value")).groupBy(*groups).agg(close(function(F.col("value"))).alias("result"))
    if width:
        return df.groupBy(*groups).agg(F.array(*(close(function(F.element_at("value", k + 1))) for k in range(width))).alias("result"))
    parts = df.select(*groups, F.posexplode("value").alias("component", "value")).groupBy(*groups, "component").agg(close(function(F.col("value"))).alias("v"))
    return parts.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "v"))), lambda s: s["v"]).alias("result"))


def accumulate(df: DataFrame, how: str = "add") -> DataFrame:
    """The running value in the order of pos, in each molecule."""
    w = Window.partitionBy("mol_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    result = RUNNING[how](F.col("value")).over(w)
    if how in ("minimum", "maximum") and isinstance(_element(df), T.FractionalType):
        result = F.when(F.bool_or(F.isnan("value")).over(w), float("nan")).otherwise(result)
    return df.select("mol_id", "pos", result.alias("result"))


def reduceat(df: DataFrame, offsets: list[int], how: str = "add") -> DataFrame:
    """Segment i runs from offset i to the next one, or is its one element where the next isn't greater; the last runs to the end."""
    spark = df.sparkSession
    ends = [*offsets[1:], None]
    rows = [(i, a, (b if b > a else a + 1) if b is not None else (1 << 62)) for i, (a, b) in enumerate(zip(offsets, ends, strict=True))]
    segments = spark.createDataFrame(rows, "segment long, low long, high long")
    met = df.join(F.broadcast(segments), (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))
    return met.groupBy("mol_id", "segment").agg(REDUCERS[how](F.col("value")).alias("result"))


def outer(a: DataFrame, b: DataFrame, ufunc: str) -> DataFrame:
    """A ufunc of all pairs inside a molecule: (mol_id, i, j, result).  The result is as large as it says."""
    right = b.select("mol_id", F.col("pos").alias("j"), F.col("value").alias("other"))
    return a.join(right, "mol_id").select("mol_id", F.col("pos").alias("i"), "j", npsem.UFUNCS[ufunc](F.col("value"), F.col("other")).alias("result"))


def edge_nodes(edges: DataFrame) -> DataFrame:
    """(mol_id, idx): the distinct ends of edges."""
    return edges.select("mol_id", F.explode(F.array("src", "dst")).alias("idx")).distinct()


def shape(df: DataFrame) -> tuple[int, ...]:
    """Rows, and for arrays the inner length."""
    if df.schema["value"].dataType.typeName() != "array":
        return (df.count(),)
    row = df.agg(F.count("*").alias("n"), F.max(F.size("value")).alias("d")).first()
    return row["n"], row["d"] or 0
