"""Features as values: a column over a view's nodes or over edges, with NumPy's operators on it.

A feature holds a plan (mol_id, pos, idx, value) or (mol_id, eid, src, dst, value) and never changes.  Operators pick the ufunc
for the value's type and keep the left operand's kind; comparisons and logical ufuncs give plain tables, ufuncs of two results a tuple.
"""

from __future__ import annotations

from typing import Any, NoReturn

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import aggregate, npsem
from .errors import FeatureOperationError, IndexInvalidError

NODE, EDGE = ("mol_id", "pos", "idx"), ("mol_id", "eid", "src", "dst")


class Feature:
    """One value a node or an edge; ``key`` columns name it, ``order`` is the one that orders a molecule's values."""

    def __init__(self, df: DataFrame) -> None:
        self.keys = EDGE if "eid" in df.columns else NODE
        self.order = self.keys[1]
        self.df = df.select(*self.keys, "value")

    @property
    def is_edge(self) -> bool:
        return self.keys == EDGE

    @property
    def dtype(self) -> T.DataType:
        kind = self.df.schema["value"].dataType
        return kind.elementType if isinstance(kind, T.ArrayType) else kind

    @property
    def shape(self) -> tuple[int, ...]:
        return aggregate.shape(self.df)

    @property
    def ndim(self) -> int:
        return 1 + isinstance(self.df.schema["value"].dataType, T.ArrayType)

    @property
    def value(self) -> DataFrame:
        """The values in order."""
        return self.df.orderBy("mol_id", self.order).select("value")

    def asarray(self, mol_id: int = 0) -> np.ndarray:
        """One molecule's values in order, on the driver."""
        rows = self.df.where(F.col("mol_id") == mol_id).select(self.order, "value").toArrow().sort_by(self.order)
        return np.array(rows["value"].to_pylist())

    def nodes(self) -> DataFrame:
        """(mol_id, idx): the distinct ends of edges, sorted."""
        return aggregate.edge_nodes(self.df).orderBy("mol_id", "idx")

    def __len__(self) -> int:
        return self.df.count()

    def __bool__(self) -> NoReturn:
        raise FeatureOperationError("the truth of a feature is ambiguous")

    def __repr__(self) -> str:
        return f"<{'Edge' if self.is_edge else 'Node'}Feature of {self.dtype.simpleString()}>"

    def __getitem__(self, key: Any) -> Feature:
        """Elements by a Column over ``value``, a slice of places from 0 on, or a list of places; edges keep their ends' names.

        Places count in each molecule.  One whole number gives an element, which an edge feature can't be.
        """
        if isinstance(key, Column):
            return Feature(self.df.where(key))
        if isinstance(key, int):
            if self.is_edge:
                raise IndexInvalidError("an edge feature needs one-dimensional indices")
            key = [key]
        w = Window.partitionBy("mol_id").orderBy(self.order)
        placed = self.df.withColumn("place", F.row_number().over(w) - 1)
        if isinstance(key, slice):
            if (key.step or 1) != 1 or any(v is not None and v < 0 for v in (key.start, key.stop)):
                raise IndexInvalidError("slices of features count from the start, by ones")
            kept = placed.where(F.col("place") >= (key.start or 0))
            return Feature(kept if key.stop is None else kept.where(F.col("place") < key.stop))
        asked = self.df.sparkSession.createDataFrame([(k, int(p)) for k, p in enumerate(key)], "new long, place int")
        sized = placed.withColumn("place_n", F.count(F.lit(1)).over(Window.partitionBy("mol_id"))) if any(p < 0 for p in key) else placed.withColumn("place_n", F.lit(0))
        found = sized.withColumnRenamed("place", "at").join(F.broadcast(asked), (F.col("at") == F.col("place")) | (F.col("at") - F.col("place_n") == F.col("place")))
        return Feature(found.withColumn(self.order, F.col("new")))

    # ufuncs

    def apply(self, name: str, *others: Any) -> Feature | DataFrame | tuple[Feature, ...]:
        """A ufunc of this feature and others of the same nodes or edges, scalars, or a row for features of several values."""
        df, columns, kinds = self.df, [F.col("value")], [self.dtype]
        for k, other in enumerate(others):
            if isinstance(other, Feature):
                if other.keys != self.keys:
                    raise FeatureOperationError("a node feature and an edge feature don't go together")
                df = df.join(other.df.select("mol_id", self.order, F.col("value").alias(f"other{k}")), ["mol_id", self.order])
                columns.append(F.col(f"other{k}"))
                kinds.append(other.dtype)
            else:
                columns.append(other)
                kinds.append(T.LongType() if isinstance(other, int) and not isinstance(other, bool) else T.BooleanType() if isinstance(other, bool) else T.StringType() if isinstance(other, str) else T.DoubleType())
        function = npsem.ufunc(name, kinds)
        literal = lambda c: c if isinstance(c, Column) else F.lit(c)
        if self.ndim == 2 and len(columns) == 1:
            result = F.transform(columns[0], function)
        elif self.ndim == 2 and isinstance(others[0], Feature) and others[0].ndim == 2:
            result = F.zip_with(columns[0], columns[1], function)
        elif self.ndim == 2:
            result = npsem.broadcast(columns[0], columns[1], function)
        else:
            result = function(*map(literal, columns))
        if name in npsem.PLAIN:
            return df.select("mol_id", self.order, result.alias("result"))
        if isinstance(result, tuple):
            return tuple(Feature(df.select(*self.keys, r.alias("value"))) for r in result)
        return Feature(df.select(*self.keys, result.alias("value")))

    def reduce(self, how: str, **options: Any) -> DataFrame:
        return aggregate.aggregate(self.df, how, **options)

    def mean(self, **options: Any) -> DataFrame:
        return self.reduce("mean", **options)

    def sum(self, **options: Any) -> DataFrame:
        return self.reduce("sum", **options)

    def min(self, **options: Any) -> DataFrame:
        return self.reduce("min", **options)

    def max(self, **options: Any) -> DataFrame:
        return self.reduce("max", **options)

    def at(self, *_: Any) -> NoReturn:
        raise FeatureOperationError("features never change; in-place operations aren't supported")

    __hash__ = object.__hash__


def _forth(name: str):
    return lambda self, other: self.apply(name, other)


def _back(name: str):
    def run(self: Feature, other: Any) -> Any:
        kind = T.LongType() if isinstance(other, int) else T.DoubleType()
        function = npsem.ufunc(name, [kind, self.dtype])
        swapped = (lambda x: function(F.lit(other), x)) if self.ndim == 1 else None
        result = swapped(F.col("value")) if swapped else F.transform("value", lambda x: function(F.lit(other), x))
        if isinstance(result, tuple):
            return tuple(Feature(self.df.select(*self.keys, r.alias("value"))) for r in result)
        return Feature(self.df.select(*self.keys, result.alias("value")))

    return run


# Python's operators and the ufuncs they stand for.
OPERATORS = {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "remainder", "divmod": "divmod", "pow": "power", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor"}
COMPARISONS = {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}
for _operator, _name in OPERATORS.items():
    setattr(Feature, f"__{_operator}__", _forth(_name))
    setattr(Feature, f"__r{_operator}__", _back(_name))
    if _operator != "divmod":
        setattr(Feature, f"__i{_operator}__", Feature.at)
for _operator, _name in COMPARISONS.items():
    setattr(Feature, f"__{_operator}__", _forth(_name))
for _operator, _name in {"neg": "negative", "pos": "positive", "abs": "absolute", "invert": "invert"}.items():
    setattr(Feature, f"__{_operator}__", lambda self, name=_name: self.apply(name))
