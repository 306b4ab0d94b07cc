"""Operators over whole molecules: write back, extract, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import FeatureKeyError, FeatureOperationError, IndexInvalidError, IndexMismatchError
from .molset import KEYS, Container, Level, MolSet
from .view import View, running


def with_features(view: View, features: dict[str, Column | DataFrame]) -> MolSet:
    """The set with node features replaced at the view's elements.

    A value is a Column over the view's features or a table (mol_id, pos, value).  Values are cast to the old
    type; where an element occurs more than once the last position wins.
    """
    container = view.mol.containers[view.level]
    container.check(*features)
    if edges := [k for k in features if k in container.edges]:
        raise FeatureOperationError(f"only node features can be replaced: {edges}")
    nodes = container.nodes
    for key, value in features.items():
        if isinstance(value, Column):
            rows = view.joined().select("mol_id", "pos", "idx", value.alias("value"))
        else:
            rows = view.dense().df.join(value.select("mol_id", "pos", "value"), ["mol_id", "pos"])
        last = rows.groupBy("mol_id", "idx").agg(F.max_by(F.struct("value"), "pos").alias("new"))
        kind = container.nodes.schema[key].dataType
        joined = nodes.join(last, ["mol_id", "idx"], "left")
        nodes = joined.withColumn(key, F.when(F.col("new").isNotNull(), F.col("new.value").cast(kind)).otherwise(F.col(key))).select(*container.nodes.columns)
    return view.mol.replace(view.level, Container(view.level, nodes, container.edges))


def extract(view: View, validate: bool = False) -> MolSet:
    """A new set of the view's elements, their parents and, from a parent level, their children.

    Elements come in first-occurrence order, parents in that of their first chosen child; edges are cropped at all levels.
    """
    mol = view.mol
    views = {lv: view.to(lv, unique=True).dense() for lv in Level}
    if validate and views[Level.ATOM].is_empty():
        raise IndexInvalidError("nothing to extract")
    place = {lv: v.df.select("mol_id", F.col("idx").alias("old"), F.col("pos").alias("new")) for lv, v in views.items()}
    containers = []
    for lv in Level:
        nodes = mol.containers[lv].nodes
        out = nodes.join(place[lv], (nodes["mol_id"] == place[lv]["mol_id"]) & (nodes["idx"] == place[lv]["old"])).drop(place[lv]["mol_id"]).drop("idx", "old").withColumnRenamed("new", "idx")
        for key, parent in (("residue_idx", Level.RESIDUE), ("chain_idx", Level.CHAIN)):
            if key in KEYS[lv]:
                up = place[parent].select("mol_id", F.col("old").alias(key), F.col("new").alias("_new"))
                out = out.join(up, ["mol_id", key]).drop(key).withColumnRenamed("_new", key)
        containers.append(Container(lv, out.select(*nodes.columns), {k: views[lv].crop(e) for k, e in mol.containers[lv].edges.items()}))
    new = MolSet(*containers)
    new.metadata = mol.metadata
    return new


def concat_containers(containers: list[Container], offsets: list[tuple[int, ...]] | None = None) -> Container:
    """Append containers of one molecule each; edge ends move by the nodes before them.

    ``offsets`` holds, for each container, what to add to the indices named in KEYS after ``mol_id``; by default
    only ``idx`` moves.
    """
    if not containers:
        raise ValueError("nothing to concatenate")
    first = containers[0]
    for c in containers[1:]:
        if set(c.keys()) != set(first.keys()):
            raise FeatureKeyError("containers must have the same feature keys")
        if set(c.edges) != set(first.edges):
            raise FeatureKeyError("a feature must be of one kind in all containers")
    names = KEYS[first.level][1:]
    if offsets is None:
        offsets, n = [], 0
        for c in containers:
            offsets.append((n, *(0,) * (len(names) - 1)))
            n += len(c)
    nodes, edges, eid = None, dict.fromkeys(first.edges), dict.fromkeys(first.edges, 0)
    for c, off in zip(containers, offsets, strict=True):
        moved = c.nodes.select(F.lit(0).cast("long").alias("mol_id"), *((F.col(k) + o).cast("long").alias(k) for k, o in zip(names, off, strict=True)), *first.node_keys())
        nodes = moved if nodes is None else nodes.unionByName(moved)
        for key in first.edges:
            e = c.edges[key]
            part = e.select(F.lit(0).cast("long").alias("mol_id"), (F.col("eid") + eid[key]).cast("long").alias("eid"), (F.col("src") + off[0]).cast("long").alias("src"), (F.col("dst") + off[0]).cast("long").alias("dst"), "value")
            edges[key] = part if edges[key] is None else edges[key].unionByName(part)
            eid[key] += (e.agg(F.max("eid")).first()[0] or 0) + 1
    return Container(first.level, nodes.select(*KEYS[first.level], *first.node_keys()), edges)


def concat(mols: list[MolSet]) -> MolSet:
    """One molecule from several sets of one molecule each; the metadata is a copy of the first's."""
    if not mols:
        raise ValueError("nothing to concatenate")
    for m in mols:
        ends = m.containers[Level.CHAIN].nodes.agg(F.min("mol_id").alias("a"), F.max("mol_id").alias("b")).first()
        if ends["a"] != ends["b"]:
            raise IndexMismatchError("a set of several molecules: make it one with merge() first")
    sizes = [[len(m.containers[lv]) for lv in Level] for m in mols]
    before = [[sum(s[k] for s in sizes[:i]) for k in range(3)] for i in range(len(mols))]
    offsets = {Level.ATOM: lambda b: (b[0], b[1], b[2]), Level.RESIDUE: lambda b: (b[1], b[2]), Level.CHAIN: lambda b: (b[2],)}
    parts = [concat_containers([m.containers[lv] for m in mols], [offsets[lv](b) for b in before]) for lv in Level]
    return MolSet(*parts, dict(mols[0].metadata))


def _offsets(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """(mol_id, offsets): for each molecule what the molecules before it hold."""
    rows = counts.withColumnRenamed("mol_id", "pos").withColumn("mol_id", F.lit(0))
    for count, offset in names.items():
        rows = running(rows, F.col(count)).withColumnRenamed("before", offset)
    return rows.select(F.col("pos").alias("mol_id"), *names.values())


def merge(mol: MolSet) -> MolSet:
    """All molecules of a set as one, in the order of ``mol_id``: concat without a driver-side list.

    Offsets come from one row a molecule, summed by ranges of ``mol_id``, so no task sees all molecules.
    """
    counts = None
    for lv, name in zip(Level, ("a", "r", "c"), strict=True):
        n = mol.containers[lv].nodes.groupBy("mol_id").agg(F.count("*").alias(f"n_{name}"))
        counts = n if counts is None else counts.join(n, "mol_id", "full")
    counts = counts.na.fill(0)
    shift = _offsets(counts, {f"n_{k}": f"o_{k}" for k in "arc"})
    own = {Level.ATOM: {"idx": "o_a", "residue_idx": "o_r", "chain_idx": "o_c"}, Level.RESIDUE: {"idx": "o_r", "chain_idx": "o_c"}, Level.CHAIN: {"idx": "o_c"}}
    parts = []
    for lv in Level:
        c = mol.containers[lv]
        nodes = c.nodes.join(shift, "mol_id").select(F.lit(0).cast("long").alias("mol_id"), *((F.col(k) + F.col(o)).cast("long").alias(k) for k, o in own[lv].items()), *c.node_keys())
        edges = {}
        for key, e in c.edges.items():
            per = e.groupBy("mol_id").agg((F.max("eid") + 1).alias("n"))
            eids = _offsets(per, {"n": "o_e"})
            o = own[lv]["idx"]
            edges[key] = e.join(shift, "mol_id").join(eids, "mol_id").select(F.lit(0).cast("long").alias("mol_id"), (F.col("eid") + F.col("o_e")).cast("long").alias("eid"), (F.col("src") + F.col(o)).cast("long").alias("src"), (F.col("dst") + F.col(o)).cast("long").alias("dst"), "value")
        parts.append(Container(lv, nodes, edges))
    return MolSet(*parts, dict(mol.metadata))
