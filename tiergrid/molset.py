"""Many molecules as tables: nodes of three levels, edges, metadata; all keyed by ``mol_id``.

A node table holds ``mol_id``, ``idx`` (dense from 0 in each molecule), its parents' indices and a column a node feature.
Atoms carry ``residue_idx`` and ``chain_idx``, so that a hop over two levels is one join.  An edge table holds ``mol_id``,
``eid`` (array order), ``src``, ``dst`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FeatureKeyError, FeatureOperationError, IndexInvalidError, IndexMismatchError, IndexOutOfBoundsError, StructureLevelError

if TYPE_CHECKING:
    from .view import View


class Level(str, Enum):
    ATOM = "atom"
    RESIDUE = "residue"
    CHAIN = "chain"

    @classmethod
    def of(cls, level: str) -> Level:
        try:
            return cls(level)
        except ValueError:
            raise StructureLevelError(f"unknown level {level!r}") from None


KEYS = {Level.ATOM: ("mol_id", "idx", "residue_idx", "chain_idx"), Level.RESIDUE: ("mol_id", "idx", "chain_idx"), Level.CHAIN: ("mol_id", "idx")}
EDGE_COLUMNS = ("mol_id", "eid", "src", "dst", "value")


class Container:
    """Node features and edge features of one level.  Immutable: update and remove return a new one."""

    def __init__(self, level: Level, nodes: DataFrame, edges: dict[str, DataFrame] | None = None) -> None:
        self.level, self.nodes, self.edges = level, nodes, dict(edges or {})
        missing = [c for c in KEYS[level] if c not in nodes.columns]
        if missing:
            raise FeatureKeyError(f"{level.value} table lacks {missing}")
        if not self.node_keys():
            raise FeatureKeyError("a container needs at least one node feature")
        if both := set(self.node_keys()) & set(self.edges):
            raise FeatureKeyError(f"both node and edge features: {sorted(both)}")
        for key, edge in self.edges.items():
            if lacking := [c for c in EDGE_COLUMNS if c not in edge.columns]:
                raise IndexMismatchError(f"edge feature {key!r} lacks {lacking}")

    def node_keys(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in KEYS[self.level]]

    def keys(self) -> list[str]:
        return [*self.node_keys(), *self.edges]

    def __contains__(self, key: str) -> bool:
        return key in self.edges or key in self.node_keys()

    def __getitem__(self, key: str) -> DataFrame:
        self.check(key)
        return self.edges[key] if key in self.edges else self.nodes.select("mol_id", "idx", F.col(key).alias("value"))

    def __len__(self) -> int:
        return self.nodes.count()

    def __repr__(self) -> str:
        return f"Container(keys={self.keys()})"

    def check(self, *keys: str) -> None:
        for key in keys:
            if key not in self:
                raise FeatureKeyError(key)

    def update(self, **features: DataFrame | Column) -> Container:
        """Add or replace features: a Column over the node table, a table (mol_id, idx, value) or an edge table."""
        nodes, edges = self.nodes, dict(self.edges)
        for key, value in features.items():
            if isinstance(value, Column):
                nodes, _ = nodes.withColumn(key, value), edges.pop(key, None)
            elif "eid" in value.columns:
                edges[key] = value
                nodes = nodes.drop(key)
            else:
                nodes = nodes.drop(key).join(value.select("mol_id", "idx", F.col("value").alias(key)), ["mol_id", "idx"])
                edges.pop(key, None)
        return Container(self.level, nodes, edges)

    def remove(self, *keys: str) -> Container:
        self.check(*keys)
        return Container(self.level, self.nodes.drop(*(k for k in keys if k not in self.edges)), {k: v for k, v in self.edges.items() if k not in keys})

    def validate(self) -> None:
        """Check indices in two aggregates: nodes dense from 0, edge ends inside."""
        bad = self.nodes.groupBy("mol_id").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
        if not bad.where("lo < 0").isEmpty():
            raise IndexInvalidError("negative node index")
        if not bad.where("n <> d or hi <> n - 1").isEmpty():
            raise IndexMismatchError("node indices aren't dense")
        for key, edge in self.edges.items():
            sizes = bad.select("mol_id", "n")
            ends = edge.groupBy("mol_id").agg(F.least(F.min("src"), F.min("dst")).alias("lo"), F.greatest(F.max("src"), F.max("dst")).alias("hi")).join(sizes, "mol_id", "left")
            if not ends.where("lo < 0").isEmpty():
                raise IndexInvalidError(f"negative end in edge feature {key!r}")
            if not ends.where("n is null or hi >= n").isEmpty():
                raise IndexOutOfBoundsError(f"edge feature {key!r} points outside its nodes")


class MolSet:
    """Three containers and metadata, which may be a function that gives it when first asked for.  Views of different sets don't mix, even over equal tables."""

    def __init__(self, atoms: Container, residues: Container, chains: Container, metadata: dict | Callable[[], dict] | None = None, validate: bool = False) -> None:
        self.containers = {Level.ATOM: atoms, Level.RESIDUE: residues, Level.CHAIN: chains}
        self._metadata = metadata or {}
        if validate:
            self.validate()

    @property
    def metadata(self) -> dict:
        if callable(self._metadata):
            self._metadata = self._metadata()
        return self._metadata

    @metadata.setter
    def metadata(self, metadata: dict) -> None:
        self._metadata = metadata

    @classmethod
    def from_tables(cls, atoms: DataFrame, residues: DataFrame, chains: DataFrame, edges: dict[str, dict[str, DataFrame]] | None = None, metadata: dict | None = None, validate: bool = False) -> MolSet:
        """From node tables; atoms without ``chain_idx`` get it from their residue."""
        edges = edges or {}
        if "chain_idx" not in atoms.columns:
            up = residues.select("mol_id", F.col("idx").alias("residue_idx"), "chain_idx")
            atoms = atoms.join(up, ["mol_id", "residue_idx"])
        return cls(*(Container(lv, df, edges.get(lv.value)) for lv, df in zip(Level, (atoms, residues, chains), strict=True)), metadata, validate)

    def get_container(self, level: str) -> Container:
        return self.containers[Level.of(level)]

    def validate(self) -> None:
        """Every check on the data, as aggregates: dense nodes, edge ends, parents inside their level."""
        for container in self.containers.values():
            container.validate()
        for child, key, parent in ((Level.ATOM, "residue_idx", Level.RESIDUE), (Level.RESIDUE, "chain_idx", Level.CHAIN)):
            up = self.containers[child].nodes.groupBy("mol_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
            sizes = self.containers[parent].nodes.groupBy("mol_id").agg((F.max("idx") + 1).alias("n"))
            both = up.join(sizes, "mol_id", "full")
            if not both.where("lo < 0").isEmpty():
                raise IndexInvalidError(f"{key} holds negative values")
            if not both.where("hi >= n").isEmpty():
                raise IndexOutOfBoundsError(f"{key} points outside the {parent.value}s")
            if not both.where("n is null or hi is null").isEmpty():
                raise IndexMismatchError(f"molecules with {child.value}s and with {parent.value}s differ")

    def replace(self, level: Level, container: Container) -> MolSet:
        """The same set with another container; metadata is shared."""
        out = MolSet(*({**self.containers, level: container}[lv] for lv in Level))
        out._metadata = self._metadata
        return out

    def update_features(self, level: str, **features: DataFrame | Column) -> MolSet:
        level = Level.of(level)
        return self.replace(level, self.containers[level].update(**features))

    def remove_features(self, level: str, *keys: str) -> MolSet:
        level = Level.of(level)
        return self.replace(level, self.containers[level].remove(*keys))

    def copy(self) -> MolSet:
        """Tables never change, so a copy shares them; metadata is copied one level deep."""
        return MolSet(*self.containers.values(), dict(self.metadata))

    @property
    def index_table(self) -> IndexTable:
        return IndexTable(self)

    def view(self, level: str) -> View:
        from .view import View

        level = Level.of(level)
        nodes = self.containers[level].nodes
        return View(self, level, nodes.select("mol_id", F.col("idx").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx")), unique=True, full=True, dense=True)

    @property
    def atoms(self) -> View:
        return self.view(Level.ATOM)

    @property
    def residues(self) -> View:
        return self.view(Level.RESIDUE)

    @property
    def chains(self) -> View:
        return self.view(Level.CHAIN)

    def __add__(self, other: MolSet) -> MolSet:
        from .structure import concat

        return concat([self, other])

    def __repr__(self) -> str:
        a, r, c = (len(x) for x in self.containers.values())
        return f"<MolSet with {a} atoms, {r} residues, and {c} chains>"


class IndexTable:
    """The parents of one molecule's atoms and residues, and moves between its levels.

    Built from lists on the driver, or over a set's own tables (``MolSet.index_table``), where nothing is collected.
    """

    def __init__(self, mol: MolSet) -> None:
        self.mol = mol

    @classmethod
    def from_parents(cls, spark: SparkSession, atom_to_res: list[int], res_to_chain: list[int], n_chain: int | None = None) -> IndexTable:
        """Parents may be without children; ``n_chain`` is by default one more than the last chain named."""
        for name, parents in (("atom_to_res", atom_to_res), ("res_to_chain", res_to_chain)):
            if not len(parents) or any(isinstance(p, (list, tuple)) or int(p) < 0 for p in parents):
                raise IndexInvalidError(f"{name} must be one-dimensional, not empty and not negative")
        if max(atom_to_res) >= len(res_to_chain):
            raise IndexOutOfBoundsError("atom_to_res points outside the residues")
        n_chain = max(res_to_chain) + 1 if n_chain is None else n_chain
        if n_chain <= max(res_to_chain):
            raise IndexOutOfBoundsError("res_to_chain points outside the chains")
        atoms = [(0, i, int(r), int(res_to_chain[r]), i) for i, r in enumerate(atom_to_res)]
        residues = [(0, i, int(c), i) for i, c in enumerate(res_to_chain)]
        make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
        return cls(MolSet.from_tables(make(atoms, (*KEYS[Level.ATOM], "id")), make(residues, (*KEYS[Level.RESIDUE], "id")), make([(0, i, i) for i in range(n_chain)], (*KEYS[Level.CHAIN], "id"))))

    def convert(self, indices: list[int], source: str, target: str) -> DataFrame:
        """(mol_id, pos, idx): the target level's indices for those of the source, in order; the same level gives them back."""
        return self.mol.view(source).new(indices).to(target).df

    def children(self, level: str) -> DataFrame:
        """For each residue its atoms, or for each chain its residues, as ``csr`` gives them."""
        above, below, key = {Level.RESIDUE: (Level.RESIDUE, Level.ATOM, "residue_idx"), Level.CHAIN: (Level.CHAIN, Level.RESIDUE, "chain_idx")}[Level.of(level)]
        return csr(self.mol.containers[below].nodes, key, self.mol.containers[above].nodes)

    def copy(self) -> IndexTable:
        return IndexTable(self.mol.copy())


class CifMolSet(MolSet):
    """The preset of crystallographic files: names of features by level, and typed metadata."""

    # Names of the preset's features.
    NODE_FEATURES = {
        "atom": ("id", "element", "aromatic", "stereo", "charge", "model_xyz", "xyz", "b_factor", "occupancy"),
        "residue": ("id", "formula", "one_letter_code_can", "one_letter_code", "cif_idx", "auth_idx", "chem_comp_id", "hetero"),
        "chain": ("entity_id", "entity_type", "chain_id", "auth_asym_id", "cluster_id", "seq_id"),
    }
    EDGE_FEATURES = {"atom": ("bond_type", "bond_aromatic", "bond_stereo"), "residue": ("bond", "struct_conn"), "chain": ("contact",)}

    id = property(lambda self: self.metadata["id"])
    assembly_id = property(lambda self: self.metadata["assembly_id"])
    model_id = property(lambda self: self.metadata["model_id"])
    alt_id = property(lambda self: self.metadata["alt_id"])

    def missing_features(self) -> list[tuple[str, str]]:
        """(level, name) of the preset's features that this set lacks."""
        return [(lv.value, k) for lv, c in self.containers.items() for k in (*self.NODE_FEATURES[lv.value], *self.EDGE_FEATURES[lv.value]) if k not in c]


def csr(children: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """(mol_id, parent, start, end, children): the children of every parent, ascending, with offsets into their
    concatenation; childless parents have an empty range."""
    from pyspark.sql import Window

    own = children.groupBy("mol_id", F.col(parent).alias("parent")).agg(F.array_sort(F.collect_list("idx")).alias("children"))
    rows = parents.select("mol_id", F.col("idx").alias("parent")).join(own, ["mol_id", "parent"], "left")
    rows = rows.withColumn("children", F.coalesce("children", F.array().cast("array<long>")))
    w = Window.partitionBy("mol_id").orderBy("parent").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.size("children")).over(w)
    return rows.select("mol_id", "parent", (end - F.size("children")).cast("long").alias("start"), end.cast("long").alias("end"), "children")


__all__ = ["CifMolSet", "Container", "FeatureOperationError", "Level", "MolSet", "csr"]
