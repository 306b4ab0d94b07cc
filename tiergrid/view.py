"""Views: ordered multisets of node indices at one level, as tables (mol_id, pos, idx).

``pos`` orders a view and may have gaps; it is made dense only where positions count (slices, lengths).  Every operation is a plan;
nothing runs before a result is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import npsem
from .errors import IndexInvalidError, IndexOutOfBoundsError, ViewOperationError
from .feature import Feature
from .molset import Container, Level, MolSet

UP = {(Level.ATOM, Level.RESIDUE): "residue_idx", (Level.ATOM, Level.CHAIN): "chain_idx", (Level.RESIDUE, Level.CHAIN): "chain_idx"}


#: Places that one task counts through.
RANGE = 1 << 20


def running(df: DataFrame, weight: Column) -> DataFrame:
    """``df`` with ``before``: the weights of the rows of its molecule that have a smaller ``pos``.

    A molecule is cut into ranges of places; sums of whole ranges, a row a range, give the offsets, so that no task
    sees a whole molecule however large it is.
    """
    cut = df.withColumn("range_at", F.floor(F.col("pos") / RANGE))
    sums = cut.groupBy("mol_id", "range_at").agg(F.sum(weight).alias("range_sum"))
    ahead = Window.partitionBy("mol_id").orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("mol_id", "range_at", F.coalesce(F.sum("range_sum").over(ahead), F.lit(0)).alias("range_before"))
    inside = Window.partitionBy("mol_id", "range_at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return cut.withColumn("before", own).join(sums, ["mol_id", "range_at"]).withColumn("before", (F.col("before") + F.col("range_before")).cast("long")).drop("range_at", "range_before")


class View:
    """An ordered selection; ``unique`` and ``full`` say what is known of it, and spare work."""

    def __init__(self, mol: MolSet, level: Level, df: DataFrame, unique: bool = False, full: bool = False, dense: bool = False) -> None:
        self.mol, self.level, self.df = mol, level, df
        self._unique, self._full, self._dense = unique, full, dense

    # what a view holds

    @property
    def nodes(self) -> DataFrame:
        return self.mol.containers[self.level].nodes

    def _with(self, df: DataFrame, **flags: bool) -> View:
        return View(self.mol, self.level, df, **flags)

    def dense(self) -> View:
        """The same view with pos = 0 .. n - 1 in each molecule."""
        if self._dense:
            return self
        df = running(self.df, F.lit(1)).select("mol_id", F.col("before").alias("pos"), "idx")
        return self._with(df, unique=self._unique, full=self._full, dense=True)

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def __bool__(self) -> bool:
        return not self.is_empty()

    def __iter__(self) -> Iterator[View]:
        """Views of one element each, in order; rows are fetched partition by partition."""
        spark = self.df.sparkSession
        for row in self.df.orderBy("mol_id", "pos").toLocalIterator():
            yield self._with(spark.createDataFrame([(row["mol_id"], 0, row["idx"])], self.df.schema), unique=True, dense=True)

    def __repr__(self) -> str:
        return f"<{self.level.value.title()}View with {len(self)} elements>"

    # features

    def joined(self) -> DataFrame:
        """The view with all node features of its elements; unread columns are pruned."""
        nodes = self.nodes
        if self._full:
            return nodes.withColumn("pos", F.col("idx").cast("long"))
        return self.df.join(nodes, ["mol_id", "idx"])

    def get_feature(self, key: str) -> DataFrame:
        """(mol_id, pos, idx, value), or for an edge feature the cropped edges (mol_id, eid, src, dst, value)."""
        container = self.mol.containers[self.level]
        container.check(key)
        if key in container.edges:
            return self.crop(container.edges[key])
        return self.joined().select("mol_id", "pos", "idx", F.col(key).alias("value"))

    def feature(self, key: str) -> Feature:
        """The feature as a value with NumPy's operators."""
        return Feature(self.get_feature(key))

    def __getattr__(self, key: str) -> DataFrame:
        if key.startswith("_"):
            raise AttributeError(key)
        return self.get_feature(key)

    def crop(self, edges: DataFrame) -> DataFrame:
        """Edges with both ends in the view, the ends renamed to the first position of each node."""
        first = self.dense().df.groupBy("mol_id", "idx").agg(F.min("pos").alias("pos")) if not self._unique else self.dense().df
        a = first.select("mol_id", F.col("idx").alias("src"), F.col("pos").alias("new_src"))
        b = first.select("mol_id", F.col("idx").alias("dst"), F.col("pos").alias("new_dst"))
        kept = edges.join(a, ["mol_id", "src"]).join(b, ["mol_id", "dst"])
        return kept.select("mol_id", "eid", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "value")

    def get_container(self) -> Container:
        """All features, cropped; a node's idx is its position."""
        container = self.mol.containers[self.level]
        rows = self.dense()._with(self.dense().df, unique=self._unique).joined().drop("idx").withColumnRenamed("pos", "idx")
        return Container(self.level, rows.select(*container.nodes.columns), {k: self.crop(e) for k, e in container.edges.items()})

    # selection

    def select(self, **wanted: Any) -> View:
        """Elements whose features match: a value, or any of a list, tuple or set.

        An edge feature is matched over the whole molecule; elements that are an end of a matching edge stay.
        """
        if not wanted:
            return self
        container = self.mol.containers[self.level]
        container.check(*wanted)
        rows, edges = self.joined(), []
        for key, value in wanted.items():
            if key in container.edges:
                found = container.edges[key].where(npsem.matches(container.edges[key], "value", value))
                ends = found.select("mol_id", F.explode(F.array("src", "dst")).alias("idx")).distinct()
                edges.append(ends.select("mol_id", F.col("idx").cast("long").alias("idx")))
            else:
                rows = rows.where(npsem.matches(container.nodes, key, value))
        out = rows.select("mol_id", "pos", F.col("idx").cast("long").alias("idx"))
        for ends in edges:
            out = out.join(ends, ["mol_id", "idx"], "left_semi").select("mol_id", "pos", "idx")
        return self._with(out, unique=self._unique)

    def where(self, mask: Column) -> View:
        """Elements for which a Column over the view's own features is true."""
        return self._with(self.joined().where(mask).select("mol_id", "pos", F.col("idx").cast("long").alias("idx")), unique=self._unique)

    def new(self, indices: list[int], mol_id: int = 0) -> View:
        """The view of these indices of one molecule; indices outside it raise."""
        flat = [indices] if isinstance(indices, int) else list(indices)
        if any(isinstance(i, (list, tuple)) for i in flat):
            raise IndexInvalidError("indices must be one-dimensional")
        last = self.nodes.where(F.col("mol_id") == mol_id).agg(F.max("idx")).first()[0]
        if bad := [i for i in flat if i < 0 or last is None or i > last]:
            raise IndexOutOfBoundsError(f"out of bounds: {bad}; the range is [0, {last}]")
        df = self.df.sparkSession.createDataFrame([(mol_id, p, int(i)) for p, i in enumerate(flat)], "mol_id long, pos long, idx long")
        return self._with(df, unique=len(set(flat)) == len(flat), dense=True)

    def __getitem__(self, key: Any) -> View:
        if isinstance(key, Column):
            return self.where(key)
        if isinstance(key, slice):
            return self._slice(key)
        if isinstance(key, int):
            return self._gather([key])
        values = list(key)
        if values and all(isinstance(v, bool) for v in values):
            return self._gather([i for i, v in enumerate(values) if v])
        return self._gather([int(v) for v in values])

    def _sized(self) -> DataFrame:
        dense = self.dense().df
        return dense.withColumn("n", F.count("*").over(Window.partitionBy("mol_id")))

    def _slice(self, key: slice) -> View:
        """Start, stop and step as Python has them, in each molecule."""
        step = 1 if key.step is None else int(key.step)
        if step == 0:
            raise ValueError("slice step cannot be zero")
        low, high = (0, F.col("n")) if step > 0 else (-1, F.col("n") - 1)

        def bound(v: int | None, default: Any) -> Column:
            if v is None:
                return F.lit(default) if isinstance(default, int) else default
            c = F.lit(v) if v >= 0 else F.col("n") + v
            return F.least(F.greatest(c, F.lit(low)), high)

        start, stop = (bound(key.start, 0), bound(key.stop, F.col("n"))) if step > 0 else (bound(key.start, F.col("n") - 1), bound(key.stop, -1))
        if step == 1 and (key.start is None or key.start >= 0) and (key.stop is None or key.stop >= 0):
            rows = self.dense().df.where(F.col("pos") >= (key.start or 0))
            rows = rows if key.stop is None else rows.where(F.col("pos") < key.stop)
            return self._with(rows, unique=self._unique)
        inside = (F.col("pos") >= start) & (F.col("pos") < stop) if step > 0 else (F.col("pos") <= start) & (F.col("pos") > stop)
        rows = self._sized().where(inside & (F.pmod(F.col("pos") - start, F.lit(abs(step))) == 0))
        new = (F.col("pos") - start) / step
        return self._with(rows.select("mol_id", new.cast("long").alias("pos"), "idx"), unique=self._unique, dense=True)

    def _gather(self, places: list[int]) -> View:
        """The elements at these positions of every molecule that has them; negative ones count from the end."""
        spark = self.df.sparkSession
        asked = spark.createDataFrame([(k, p) for k, p in enumerate(places)], "new long, place long")
        if all(p >= 0 for p in places):
            rows = self.dense().df.join(F.broadcast(asked), F.col("pos") == F.col("place"))
        else:
            rows = self._sized().join(F.broadcast(asked), (F.col("pos") == F.col("place")) | (F.col("pos") - F.col("n") == F.col("place")))
        return self._with(rows.select("mol_id", F.col("new").alias("pos"), "idx"))

    # order and sets

    def unique(self) -> View:
        if self._unique:
            return self
        return self._with(self.df.groupBy("mol_id", "idx").agg(F.min("pos").alias("pos")).select("mol_id", "pos", "idx"), unique=True)

    def sort(self) -> View:
        w = Window.partitionBy("mol_id").orderBy("idx", "pos")
        df = self.df.select("mol_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "idx")
        return self._with(df, unique=self._unique, full=False, dense=True)

    def _check(self, other: View) -> None:
        if not isinstance(other, View):
            raise ViewOperationError(f"not a view: {type(other)}")
        if self.mol is not other.mol:
            raise ViewOperationError("views of different sets")
        if self.level != other.level:
            raise ViewOperationError(f"views of different levels: {self.level.value} and {other.level.value}")

    def __add__(self, other: View) -> View:
        self._check(other)
        after = self.df.groupBy("mol_id").agg((F.max("pos") + 1).alias("shift"))
        moved = other.df.join(after, "mol_id", "left").select("mol_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "idx")
        return self._with(self.df.unionByName(moved))

    def __or__(self, other: View) -> View:
        return (self + other).unique()

    def __and__(self, other: View) -> View:
        self._check(other)
        return self._with(self.unique().df.join(other.df, ["mol_id", "idx"], "left_semi").select("mol_id", "pos", "idx"), unique=True)

    def __sub__(self, other: View) -> View:
        self._check(other)
        return self._with(self.unique().df.join(other.df, ["mol_id", "idx"], "left_anti").select("mol_id", "pos", "idx"), unique=True)

    def __xor__(self, other: View) -> View:
        return (self | other) - (self & other)

    def __invert__(self) -> View:
        return self.mol.view(self.level) - self

    def is_subset(self, other: View) -> bool:
        self._check(other)
        return self.df.join(other.df, ["mol_id", "idx"], "left_anti").isEmpty()

    # levels

    def to(self, level: str, unique: bool = False) -> View:
        level = Level.of(level)
        if level == self.level:
            return self.unique() if unique else self
        if (self.level, level) in UP:
            key = UP[self.level, level]
            rows = self.joined().select("mol_id", "pos", F.col(key).cast("long").alias("idx"))
            out = View(self.mol, level, rows)
        else:
            key = UP[level, self.level]
            below = self.mol.containers[level].nodes
            children = below.select("mol_id", F.col("idx").cast("long").alias("child"), F.col(key).cast("long").alias("idx"), *(["residue_idx"] if level == Level.ATOM and self.level == Level.CHAIN else []))
            order = [*(["residue_idx"] if "residue_idx" in children.columns else []), "child"]
            # a child's place: the children of the elements before its parent, and its rank under the parent
            within = Window.partitionBy("mol_id", "idx").orderBy(*order)
            ranked = children.withColumn("rank", F.row_number().over(within) - 1)
            counts = children.groupBy("mol_id", "idx").agg(F.count(F.lit(1)).alias("held"))
            parents = running(self.df.join(counts, ["mol_id", "idx"]), F.col("held")).select("mol_id", "idx", "before")
            rows = parents.join(ranked, ["mol_id", "idx"])
            rows = rows.select("mol_id", (F.col("before") + F.col("rank")).cast("long").alias("pos"), F.col("child").alias("idx"))
            out = View(self.mol, level, rows, unique=self._unique, dense=True)
        return out.unique() if unique else out

    def to_atoms(self, *, unique: bool = False) -> View:
        return self.to(Level.ATOM, unique)

    def to_residues(self, *, unique: bool = False) -> View:
        return self.to(Level.RESIDUE, unique)

    def to_chains(self, *, unique: bool = False) -> View:
        return self.to(Level.CHAIN, unique)

    @property
    def atoms(self) -> View:
        return self.to(Level.ATOM, unique=True)

    @property
    def residues(self) -> View:
        return self.to(Level.RESIDUE, unique=True)

    @property
    def chains(self) -> View:
        return self.to(Level.CHAIN, unique=True)

    # structure

    def with_features(self, **features: Column | DataFrame) -> MolSet:
        from .structure import with_features

        return with_features(self, features)

    def extract(self) -> MolSet:
        from .structure import extract

        return extract(self)
