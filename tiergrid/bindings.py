"""The driver's tables as molecules.

G: one molecule; chains region, residues nation, atoms customer; atom edges ``follow`` (a customer's order to the next order's
customer) and residue edges ``trade`` (supplier nation to customer nation).  M: a molecule for each region; chains nation, residues customer,
atoms orders, with local indices; atom edges ``next`` from an order to the same molecule's next.  W: one molecule; chains and residues by
label, atoms embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .molset import MolSet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zero(*columns: str) -> list:
    return [F.lit(0).cast("long").alias("mol_id"), *(F.col(c.split(" ")[0]).cast("long").alias(c.split(" ")[1]) for c in columns)]


def follow(spark: SparkSession, d: str) -> DataFrame:
    """Each order to the next one by key.  The orders are cut into ranges of keys; a range's last order finds its successor
    in a table of one row a range, so no task sees them all."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumn("part", F.floor(F.col("o_orderkey") / 100_000))
    w = Window.partitionBy("part").orderBy("o_orderkey")
    heads = o.groupBy("part").agg(F.min_by("o_custkey", "o_orderkey").alias("head"))
    after = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("next_head"))  # one row a range
    dst = F.coalesce(F.lead("o_custkey").over(w), "next_head")
    rows = o.join(F.broadcast(after), "part").select(*_zero("o_orderkey eid", "o_custkey src"), dst.cast("long").alias("dst"), F.col("o_orderstatus").alias("value"))
    return rows.where("dst is not null")


def trade(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.select("l_orderkey", "l_suppkey", "l_returnflag").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("l_returnflag").alias("value")).distinct()
    w = Window.orderBy("src", "dst", "value")  # at most nations squared times flags
    return rows.select(F.lit(0).cast("long").alias("mol_id"), (F.row_number().over(w) - 1).cast("long").alias("eid"), F.col("src").cast("long"), F.col("dst").cast("long"), "value")


def g(spark: SparkSession, d: str, edges: bool = False) -> MolSet:
    nation = table(spark, d, "nation")
    up = nation.select(F.col("n_nationkey").alias("_n"), F.col("n_regionkey").alias("_r"))
    atoms = table(spark, d, "customer").join(F.broadcast(up), F.col("c_nationkey") == F.col("_n"))
    atoms = atoms.select(*_zero("c_custkey idx", "c_nationkey residue_idx", "_r chain_idx"), "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    residues = nation.select(*_zero("n_nationkey idx", "n_regionkey chain_idx"), "n_name", "n_regionkey")
    chains = table(spark, d, "region").select(*_zero("r_regionkey idx"), "r_name")
    e = {"atom": {"follow": follow(spark, d)}, "residue": {"trade": trade(spark, d)}} if edges else None
    return MolSet.from_tables(atoms, residues, chains, e, {"id": "G", "assembly_id": "1", "model_id": 1, "alt_id": "."})


def m(spark: SparkSession, d: str, edges: bool = False) -> MolSet:
    def local(key: str):
        return (F.row_number().over(Window.partitionBy("mol_id").orderBy(key)) - 1).cast("long")

    chains = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("mol_id"), "n_nationkey", "n_name").withColumn("idx", local("n_nationkey"))
    up = chains.select("mol_id", F.col("n_nationkey").alias("c_nationkey"), F.col("idx").alias("chain_idx"))
    residues = table(spark, d, "customer").join(F.broadcast(up), "c_nationkey").withColumn("idx", local("c_custkey"))
    residues = residues.select("mol_id", "idx", "chain_idx", "c_custkey", "c_acctbal", "c_mktsegment")
    own = residues.select("mol_id", F.col("c_custkey").alias("o_custkey"), F.col("idx").alias("residue_idx"), "chain_idx")
    atoms = table(spark, d, "orders").join(own, "o_custkey").withColumn("idx", local("o_orderkey"))
    atoms = atoms.select("mol_id", "idx", "residue_idx", "chain_idx", "o_orderkey", "o_totalprice", "o_orderstatus")
    e = None
    if edges:
        n = F.count("*").over(Window.partitionBy("mol_id"))
        nxt = atoms.withColumn("n", n).where(F.col("idx") < F.col("n") - 1).select("mol_id", F.col("idx").alias("eid"), F.col("idx").alias("src"), (F.col("idx") + 1).alias("dst"), F.col("o_orderstatus").alias("value"))
        e = {"atom": {"next": nxt}}
    return MolSet.from_tables(atoms, residues, chains.select("mol_id", "idx", "n_nationkey", "n_name"), e, {"id": "M"})


def w(spark: SparkSession, d: str) -> MolSet:
    e = table(spark, d, "embeddings")
    atoms = e.select(*_zero("vec_id idx", "label residue_idx"), (F.col("label") % 2).cast("long").alias("chain_idx"), F.col("embedding").cast("array<double>").alias("v"), "label")
    residues = spark.range(10).select(F.lit(0).cast("long").alias("mol_id"), F.col("id").alias("idx"), (F.col("id") % 2).alias("chain_idx"), F.col("id").alias("label"))
    chains = spark.range(2).select(F.lit(0).cast("long").alias("mol_id"), F.col("id").alias("idx"), F.col("id").alias("parity"))
    return MolSet.from_tables(atoms, residues, chains)
