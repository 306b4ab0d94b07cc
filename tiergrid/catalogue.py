"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aggregate as agg
from . import bindings, codec, npsem, structure
from .feature import Feature
from .molset import csr
from .view import View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

U = npsem.UFUNCS
C = F.col

#: Common table expressions of the bindings in SQL.
G_SQL = """WITH cust AS (SELECT c_custkey AS idx, c_nationkey AS r, n_regionkey AS c, c_acctbal, c_mktsegment, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
fol AS (SELECT * FROM (SELECT o_orderkey AS eid, o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst, o_orderstatus AS value FROM orders) WHERE dst IS NOT NULL),
fends AS (SELECT src AS idx, value FROM fol UNION SELECT dst, value FROM fol),
bui AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS p FROM cust WHERE c_mktsegment = 'BUILDING')
"""
M_SQL = """WITH ch AS (SELECT n_regionkey::BIGINT AS mol_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx, n_nationkey, n_name FROM nation),
re AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY c_custkey) - 1 AS idx, ch.idx AS chain_idx, c_custkey, c_acctbal, c_mktsegment FROM customer JOIN ch ON c_nationkey = n_nationkey),
ato AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY o_orderkey) - 1 AS idx, re.idx AS residue_idx, chain_idx, o_orderkey, o_totalprice, o_orderstatus FROM orders JOIN re ON o_custkey = c_custkey)
"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def ids(v: View) -> DataFrame:
    return v.dense().df.select("mol_id", "pos", "idx")


@query("SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment <> 'BUILDING'")
def entry(spark, d):
    mol = bindings.g(spark, d)
    asia = mol.chains.select(r_name="ASIA").atoms
    return (asia - asia.select(c_mktsegment="BUILDING")).get_feature("c_acctbal").select(C("idx").alias("c_custkey"), C("value").alias("c_acctbal"))


# filters


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE c_mktsegment = 'BUILDING'")
def select_eq(spark, d):
    return ids(bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING"))


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def select_in(spark, d):
    return ids(bindings.g(spark, d).atoms.select(c_mktsegment=["BUILDING", "MACHINERY"]))


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE c_mktsegment = 'BUILDING' AND r IN (1, 3, 5, 7)")
def select_and(spark, d):
    return ids(bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING", c_nationkey=[1, 3, 5, 7]))


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE c_mktsegment = 'BUILDING' AND idx IN (SELECT idx FROM fends WHERE value = 'F')")
def select_edge(spark, d):
    return ids(bindings.g(spark, d, edges=True).atoms.select(c_mktsegment="BUILDING").select(follow="F"))


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE idx IN (SELECT idx FROM fends WHERE value IN ('F', 'P'))")
def select_edge_in(spark, d):
    return ids(bindings.g(spark, d, edges=True).atoms.select(follow=["F", "P"]))


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE c_mktsegment = 'MACHINERY' AND r = 4 AND idx IN (SELECT idx FROM fends WHERE value = 'O')")
def select_mixed(spark, d):
    return ids(bindings.g(spark, d, edges=True).atoms.select(c_mktsegment="MACHINERY", follow="O", c_nationkey=4))


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE c_acctbal > 5000")
def mask_index(spark, d):
    return ids(bindings.g(spark, d).atoms[U["greater"](C("c_acctbal"), F.lit(5000))])


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE (c_acctbal > 5000) <> (c_mktsegment = 'BUILDING')")
def mask_logical(spark, d):
    both = U["logical_xor"]((C("c_acctbal") > 5000).cast("int"), (C("c_mktsegment") == "BUILDING").cast("int"))
    return ids(bindings.g(spark, d).atoms.where(both))


@query(M_SQL + "SELECT mol_id, p AS pos, idx FROM (SELECT mol_id, idx, (n - 3 - idx) // 2 AS p, n FROM (SELECT *, count(*) OVER (PARTITION BY mol_id) AS n FROM ato)) WHERE idx <= n - 3 AND idx > 10 AND (n - 3 - idx) % 2 = 0")
def slice_index(spark, d):
    return ids(bindings.m(spark, d).atoms[-3:10:-2])


@query(M_SQL + "SELECT re.mol_id, k.p::BIGINT AS pos, re.idx FROM re JOIN (SELECT mol_id, count(*) AS n FROM re GROUP BY mol_id) s ON re.mol_id = s.mol_id JOIN (VALUES (0, 5), (1, 0), (2, 5), (3, -1)) k(p, i) ON re.idx = CASE WHEN i >= 0 THEN i ELSE n + i END")
def fancy_index(spark, d):
    return ids(bindings.m(spark, d).residues[[5, 0, 5, -1]])


@query(M_SQL + "SELECT mol_id, 0::BIGINT AS pos, max(idx) AS idx FROM ato GROUP BY mol_id")
def int_index(spark, d):
    return ids(bindings.m(spark, d).atoms[-1])


@query("SELECT 0::BIGINT AS mol_id, pos::BIGINT AS pos, idx::BIGINT AS idx FROM (VALUES (0, 7), (1, 3), (2, 7)) t(pos, idx)")
def view_new(spark, d):
    return ids(bindings.g(spark, d).atoms.new([7, 3, 7]))


@query(G_SQL + "SELECT count(*) AS n FROM bui")
def view_len(spark, d):
    return bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING").df.agg(F.count("*").alias("n"))


@query(G_SQL + "SELECT (SELECT count(*) FROM cust) AS atoms, (SELECT count(*) FROM nation) AS residues, (SELECT count(*) FROM region) AS chains")
def mol_counts(spark, d):
    mol = bindings.g(spark, d)
    a, r, c = (mol.view(k).df.agg(F.count("*").alias(f"{k}s")) for k in ("atom", "residue", "chain"))
    return a.crossJoin(r).crossJoin(c)  # one row each


# hops


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, r::BIGINT AS idx FROM cust WHERE c_mktsegment = 'BUILDING'")
def up_atoms_residues(spark, d):
    return ids(bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING").to_residues())


@query(G_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY min(idx)) - 1 AS pos, r::BIGINT AS idx FROM cust WHERE c_mktsegment = 'BUILDING' GROUP BY r")
def up_atoms_residues_unique(spark, d):
    return ids(bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING").residues)


@query("SELECT 0::BIGINT AS mol_id, n_nationkey::BIGINT AS pos, n_regionkey::BIGINT AS idx FROM nation")
def up_residues_chains(spark, d):
    return ids(bindings.g(spark, d).residues.to_chains())


@query("SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY min(n_nationkey)) - 1 AS pos, n_regionkey::BIGINT AS idx FROM nation GROUP BY n_regionkey")
def up_residues_chains_unique(spark, d):
    return ids(bindings.g(spark, d).residues.chains)


@query(M_SQL + "SELECT mol_id, idx AS pos, chain_idx AS idx FROM ato")
def up_atoms_chains(spark, d):
    return ids(bindings.m(spark, d).atoms.to_chains())


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY min(idx)) - 1 AS pos, chain_idx AS idx FROM ato GROUP BY mol_id, chain_idx")
def up_atoms_chains_unique(spark, d):
    return ids(bindings.m(spark, d).atoms.chains)


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY chain_idx, idx) - 1 AS pos, idx FROM re")
def down_chains_residues(spark, d):
    return ids(bindings.m(spark, d).chains.to_residues())


@query(M_SQL + "SELECT ato.mol_id, row_number() OVER (PARTITION BY ato.mol_id ORDER BY residue_idx, ato.idx) - 1 AS pos, ato.idx FROM ato JOIN re ON ato.mol_id = re.mol_id AND residue_idx = re.idx WHERE c_mktsegment = 'BUILDING'")
def down_residues_atoms(spark, d):
    return ids(bindings.m(spark, d).residues.select(c_mktsegment="BUILDING").to_atoms())


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY chain_idx, residue_idx, idx) - 1 AS pos, idx FROM ato")
def down_chains_atoms(spark, d):
    return ids(bindings.m(spark, d).chains.to_atoms())


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY chain_idx, residue_idx, idx) - 1 AS pos, idx FROM ato WHERE chain_idx IN (0, 2)")
def down_chains_atoms_unique(spark, d):
    return ids(bindings.m(spark, d).chains[[0, 2, 0]].atoms)


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY k, idx) - 1 AS pos, idx FROM (SELECT re.*, k FROM re JOIN (VALUES (0, 1), (1, 0), (2, 1)) v(k, c) ON chain_idx = c)")
def level_convert(spark, d):
    return ids(bindings.m(spark, d).chains[[1, 0, 1]].to("residue"))


# sets; a is BUILDING, b the rich, as views of G


def _ab(spark, d):
    atoms = bindings.g(spark, d).atoms
    return atoms.select(c_mktsegment="BUILDING"), atoms.where(C("c_acctbal") > 5000)


AB_SQL = G_SQL.rstrip() + ",\na AS (SELECT idx FROM cust WHERE c_mktsegment = 'BUILDING'), b AS (SELECT idx FROM cust WHERE c_acctbal > 5000)\n"


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY min(idx)) - 1 AS pos, residue_idx AS idx FROM ato GROUP BY mol_id, residue_idx")
def unique(spark, d):
    return ids(bindings.m(spark, d).atoms.to_residues().unique())


@query(AB_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY s, idx) - 1 AS pos, idx FROM (SELECT 0 AS s, idx FROM a UNION ALL SELECT 1, idx FROM b)")
def view_concat(spark, d):
    a, b = _ab(spark, d)
    return ids(a + b)


@query(AB_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx NOT IN (SELECT idx FROM a), idx) - 1 AS pos, idx FROM cust WHERE idx IN (SELECT idx FROM a) OR idx IN (SELECT idx FROM b)")
def union(spark, d):
    a, b = _ab(spark, d)
    return ids(a | b)


@query(AB_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM a WHERE idx IN (SELECT idx FROM b)")
def intersect(spark, d):
    a, b = _ab(spark, d)
    return ids(a & b)


@query(AB_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM a WHERE idx NOT IN (SELECT idx FROM b)")
def difference(spark, d):
    a, b = _ab(spark, d)
    return ids(a - b)


@query(AB_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx NOT IN (SELECT idx FROM a), idx) - 1 AS pos, idx FROM cust WHERE (idx IN (SELECT idx FROM a)) <> (idx IN (SELECT idx FROM b))")
def symdiff(spark, d):
    a, b = _ab(spark, d)
    return ids(a ^ b)


@query(AB_SQL + "SELECT 0::BIGINT AS mol_id, row_number() OVER (ORDER BY idx) - 1 AS pos, idx FROM cust WHERE idx NOT IN (SELECT idx FROM a)")
def invert(spark, d):
    return ids(~_ab(spark, d)[0])


@query(M_SQL + "SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY residue_idx) - 1 AS pos, residue_idx AS idx FROM ato")
def view_sort(spark, d):
    return ids(bindings.m(spark, d).atoms.to_residues().sort())


@query(AB_SQL + "SELECT NOT EXISTS (SELECT 1 FROM a WHERE idx NOT IN (SELECT idx FROM b)) AS a_in_b, true AS both_in_a")
def is_subset(spark, d):
    a, b = _ab(spark, d)
    return spark.createDataFrame([(a.is_subset(b), (a & b).is_subset(a))], "a_in_b boolean, both_in_a boolean")


# features


@query(G_SQL + "SELECT idx, c_acctbal AS value FROM cust WHERE c_mktsegment = 'BUILDING'")
def feature_node(spark, d):
    return bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING").get_feature("c_acctbal").select("idx", "value")


@query(G_SQL + "SELECT eid, a.p AS src, b.p AS dst, value FROM fol JOIN bui a ON src = a.idx JOIN bui b ON dst = b.idx")
def feature_edge(spark, d):
    return bindings.g(spark, d, edges=True).atoms.select(c_mktsegment="BUILDING").get_feature("follow").select("eid", "src", "dst", "value")


@query(G_SQL + "SELECT DISTINCT idx FROM fends WHERE value = 'P'")
def edge_nodes(spark, d):
    return agg.edge_nodes(bindings.follow(spark, d).where("value = 'P'")).select("idx")


@query(G_SQL + "SELECT eid, src, dst FROM fol")
def edge_src_dst(spark, d):
    return bindings.g(spark, d, edges=True).get_container("atom")["follow"].select("eid", "src", "dst")


@query(G_SQL + "SELECT eid, src, dst, value FROM fol WHERE value <> 'O'")
def edge_getitem(spark, d):
    return Feature(bindings.g(spark, d, edges=True).get_container("atom")["follow"])[C("value") != "O"].df.select("eid", "src", "dst", "value")


@query("SELECT count(*) AS n, max(len(embedding))::INT AS width FROM embeddings")
def feature_shape(spark, d):
    return spark.createDataFrame([agg.shape(bindings.w(spark, d).atoms.get_feature("v"))], "n long, width int")


@query("SELECT c_custkey AS idx, c_nationkey & 5 AS a, c_nationkey | 5 AS o, xor(c_nationkey, 5) AS x, ~c_nationkey AS n FROM customer")
def feature_bitwise(spark, d):
    k, five = C("c_nationkey"), F.lit(5)
    return bindings.g(spark, d).atoms.joined().select("idx", U["bitwise_and"](k, five).alias("a"), U["bitwise_or"](k, five).alias("o"), U["bitwise_xor"](k, five).alias("x"), U["invert"](k).alias("n"))


@query(G_SQL + "SELECT p AS idx, c_name, c_acctbal FROM cust JOIN bui USING (idx)")
def container_crop(spark, d):
    return bindings.g(spark, d, edges=True).atoms.select(c_mktsegment="BUILDING").get_container().nodes.select("idx", "c_name", "c_acctbal")


@query("SELECT k::BIGINT AS k, name FROM (VALUES (0, 'c_custkey'), (1, 'c_name'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment'), (5, 'follow')) t(k, name)")
def container_keys(spark, d):
    return spark.createDataFrame(list(enumerate(bindings.g(spark, d, edges=True).get_container("atom").keys())), "k long, name string")


@query("SELECT true AS valid")
def container_validate(spark, d):
    bindings.g(spark, d, edges=True).validate()
    return spark.createDataFrame([(True,)], "valid boolean")


# element-wise math


@query("SELECT c_custkey AS idx, c_acctbal * 2 + 1 AS value FROM customer")
def arith_scalar(spark, d):
    return bindings.g(spark, d).atoms.joined().select("idx", U["add"](U["multiply"](C("c_acctbal"), F.lit(2)), F.lit(1)).alias("value"))


@query("SELECT vec_id AS idx, round(list_sum([x::DOUBLE - 0.5 for x in embedding]), 6) AS value FROM embeddings")
def arith_row_broadcast(spark, d):
    moved = npsem.broadcast(C("v"), [0.5] * 64, U["subtract"])
    return bindings.w(spark, d).atoms.joined().select("idx", F.round(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x), 6).alias("value"))


@query("SELECT c_custkey AS idx, c_acctbal - c_nationkey AS value FROM customer")
def arith_feature_feature(spark, d):
    return bindings.g(spark, d).atoms.joined().select("idx", (C("c_acctbal") - C("c_nationkey")).alias("value"))


@query("SELECT c_custkey AS idx, floor((c_nationkey - 12) / 5.0)::BIGINT AS q, (c_nationkey - 12 - 5 * floor((c_nationkey - 12) / 5.0))::BIGINT AS r FROM customer")
def floor_mod(spark, d):
    k = C("c_nationkey") - 12
    return bindings.g(spark, d).atoms.joined().select("idx", U["floor_divide"](k, F.lit(5)).alias("q"), U["mod"](k, F.lit(5)).alias("r"))


@query("SELECT c_custkey AS idx, floor(c_acctbal / 7.5) AS q, floor(c_acctbal / -7.5) AS nq, (c_acctbal > 1000.5) AS gt FROM customer")
def floor_mod_float(spark, d):
    k = bindings.g(spark, d).atoms.feature("c_acctbal")
    parts = [(k // 7.5).df.select("idx", C("value").alias("q")), (k // -7.5).df.select("idx", C("value").alias("nq")), (k > 1000.5).select(C("pos").alias("idx"), C("result").alias("gt"))]
    return parts[0].join(parts[1], "idx").join(parts[2], "idx")


@query("SELECT c_custkey AS idx, c_nationkey = 0 AS nan, c_nationkey = 1 AS inf, CASE WHEN c_nationkey > 1 THEN floor(c_acctbal) END AS fl, CASE WHEN c_nationkey > 1 THEN ceil(c_acctbal) END AS ce, CASE WHEN c_nationkey > 1 THEN trunc(c_acctbal) END AS tr FROM customer")
def rounding_nan(spark, d):
    odd = F.when(C("c_nationkey") == 0, float("nan")).when(C("c_nationkey") == 1, float("inf")).otherwise(C("c_acctbal"))
    rows = bindings.g(spark, d).atoms.joined().select("idx", "c_nationkey", U["floor"](odd).alias("fl"), U["ceil"](odd).alias("ce"), U["trunc"](odd).alias("tr"))
    finite = lambda c: F.when(U["isfinite"](C(c)), C(c)).alias(c)
    return rows.select("idx", (F.isnan("fl") & F.isnan("ce") & F.isnan("tr")).alias("nan"), (U["isinf"](C("fl")) & U["isinf"](C("ce")) & U["isinf"](C("tr"))).alias("inf"), finite("fl"), finite("ce"), finite("tr"))


@query("SELECT min(9007199254740993 + o_orderkey) AS lo, max(9007199254740993 + o_orderkey) AS hi, count(*) FILTER (WHERE 9007199254740993 + o_orderkey = 9007199254740994) AS same FROM orders")
def minmax_long(spark, d):
    big = Feature(bindings.table(spark, d, "orders").select(F.lit(0).cast("long").alias("mol_id"), C("o_orderkey").alias("pos"), C("o_orderkey").alias("idx"), C("o_orderkey").alias("value"))) + 9007199254740993
    same = (big == 9007199254740994).agg(F.count_if("result").alias("same"))
    return big.min().select(C("result").alias("lo")).join(big.max().select(C("result").alias("hi"))).join(same)


@query("SELECT c_custkey AS idx, (c_nationkey * 3 - 5) * (c_nationkey + 1) AS value FROM customer")
def feature_operators(spark, d):
    k = bindings.g(spark, d).atoms.feature("c_nationkey")
    return ((k * 3 - 5) * (1 + k)).df.select("idx", "value")


@query("SELECT c_custkey AS idx, floor((c_nationkey - 12) / -7.0)::BIGINT AS q, (c_nationkey - 12 + 7 * floor((c_nationkey - 12) / -7.0))::BIGINT AS r FROM customer")
def divmod(spark, d):
    q, r = U["divmod"](C("c_nationkey") - 12, F.lit(-7))
    return bindings.g(spark, d).atoms.joined().select("idx", q.alias("q"), r.alias("r"))


@query("SELECT c_custkey AS idx, round(sin(c_nationkey), 8) AS s, round(cos(c_nationkey), 8) AS c, round(atan2(c_nationkey, 3), 8) AS t, round(degrees(c_nationkey), 8) AS g FROM customer")
def trig(spark, d):
    k = C("c_nationkey")
    return bindings.g(spark, d).atoms.joined().select("idx", *(F.round(e, 8).alias(n) for n, e in (("s", U["sin"](k)), ("c", U["cos"](k)), ("t", U["arctan2"](k, F.lit(3))), ("g", U["degrees"](k)))))


@query("SELECT c_custkey AS idx, round(exp(c_nationkey / 10.0), 8) AS e, round(ln(c_nationkey + 1), 8) AS l, round(sqrt(c_nationkey), 8) AS s FROM customer")
def explog(spark, d):
    k = C("c_nationkey")
    return bindings.g(spark, d).atoms.joined().select("idx", F.round(U["exp"](k / 10.0), 8).alias("e"), F.round(U["log"](k + 1), 8).alias("l"), F.round(U["sqrt"](k), 8).alias("s"))


@query("SELECT c_custkey AS idx, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, trunc(c_acctbal) AS t FROM customer")
def rounding(spark, d):
    a = C("c_acctbal")
    return bindings.g(spark, d).atoms.joined().select("idx", U["floor"](a).alias("f"), U["ceil"](a).alias("c"), U["trunc"](a).alias("t"))


@query("SELECT c_custkey AS idx, greatest(c_acctbal, c_nationkey * 100.0) AS hi, least(c_acctbal, c_nationkey * 100.0) AS lo FROM customer")
def minmax_pair(spark, d):
    a, b = C("c_acctbal"), C("c_nationkey") * 100.0
    return bindings.g(spark, d).atoms.joined().select("idx", U["maximum"](a, b).alias("hi"), U["minimum"](a, b).alias("lo"))


@query("SELECT vec_id AS idx, round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 8) AS x, round(2 * embedding[3]::DOUBLE, 8) AS y FROM embeddings")
def matmul_row(spark, d):
    r = npsem.matvec([[1, -1, 0], [0, 0, 2]], F.slice("v", 1, 3))
    return bindings.w(spark, d).atoms.joined().select("idx", r.alias("r")).select("idx", F.round(C("r")[0], 8).alias("x"), F.round(C("r")[1], 8).alias("y"))


@query("SELECT vec_id AS idx, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 8) AS value FROM embeddings")
def vector_norm(spark, d):
    return bindings.w(spark, d).atoms.joined().select("idx", F.round(npsem.norm(C("v")), 8).alias("value"))


@query("SELECT i, eq, lt, mx_nan, fmx FROM (VALUES (0::BIGINT, false, false, true, 1.0::DOUBLE), (1, true, false, false, 2.0), (2, false, true, false, 3.0)) t(i, eq, lt, mx_nan, fmx)")
def comparison_nan(spark, d):
    rows = spark.createDataFrame([(0, float("nan"), 1.0), (1, 2.0, 2.0), (2, 1.0, 3.0)], "i long, a double, b double")
    a, b = C("a"), C("b")
    return rows.select("i", U["equal"](a, b).alias("eq"), U["less"](a, b).alias("lt"), F.isnan(U["maximum"](a, b)).alias("mx_nan"), U["fmax"](a, b).alias("fmx"))


# aggregates


def _balance(spark, d):
    return bindings.g(spark, d).atoms.get_feature("c_acctbal")


def _agg_query(name: str, how: str, sql: str) -> None:
    def run(spark, d):
        return agg.aggregate(_balance(spark, d), how).select(F.round("result", 4).alias("result"))

    run.__name__ = name
    query(f"SELECT round({sql}, 4) AS result FROM customer")(run)


for _name, _sql in (("mean", "avg(c_acctbal)"), ("sum", "sum(c_acctbal)"), ("min", "min(c_acctbal)"), ("max", "max(c_acctbal)")):
    _agg_query(f"agg_{_name}", _name, _sql)


@query("SELECT label, k::INT AS k, round(avg(x), 8) AS value FROM (SELECT label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY label, k")
def agg_axis0(spark, d):
    v = bindings.w(spark, d).atoms.joined().select(C("residue_idx").alias("label"), C("v").alias("value"))
    return agg.aggregate(v, "mean", axis=0, by=["label"], width=64).select("label", F.posexplode("result").alias("k", "value")).select("label", "k", F.round("value", 8).alias("value"))


@query("SELECT vec_id AS idx, round(list_sum([x::DOUBLE for x in embedding]), 8) AS result FROM embeddings")
def agg_axis1(spark, d):
    return agg.aggregate(bindings.w(spark, d).atoms.get_feature("v"), "sum", axis=1).select("idx", F.round("result", 8).alias("result"))


@query("SELECT round(sum(x), 6) AS result FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def agg_all(spark, d):
    return agg.aggregate(bindings.w(spark, d).atoms.get_feature("v"), "sum").select(F.round("result", 6).alias("result"))


@query("SELECT round(sum(c_acctbal) + 100, 4) AS result FROM customer WHERE c_acctbal > 0")
def agg_where(spark, d):
    return agg.aggregate(_balance(spark, d), "sum", where=C("value") > 0, initial=100.0).select(F.round("result", 4).alias("result"))


@query("SELECT bool_and(c_acctbal > -1000) AS every, bool_or(c_acctbal > 9900) AS any FROM customer")
def reduce_logical(spark, d):
    v = _balance(spark, d)
    return v.agg(agg.REDUCERS["logical_and"](C("value") > -1000).alias("every"), agg.REDUCERS["logical_or"](C("value") > 9900).alias("any"))


@query("SELECT bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM customer")
def reduce_bit(spark, d):
    v = bindings.g(spark, d).atoms.get_feature("c_custkey")
    return v.agg(*(agg.REDUCERS[f"bitwise_{n}"](C("value")).alias(n[0]) for n in ("and", "or", "xor")))


@query(M_SQL + "SELECT mol_id, idx AS pos, round(sum(c_acctbal) OVER (PARTITION BY mol_id ORDER BY idx), 2) AS result FROM re")
def accumulate(spark, d):
    return agg.accumulate(bindings.m(spark, d).residues.get_feature("c_acctbal")).select("mol_id", "pos", F.round("result", 2).alias("result"))


@query(M_SQL + "SELECT mol_id, segment::BIGINT AS segment, round(sum(c_acctbal), 4) AS result FROM re JOIN (VALUES (0, 0, 10), (1, 10, 11), (2, 5, 20), (3, 20, 1000000000)) s(segment, lo, hi) ON idx >= lo AND idx < hi GROUP BY ALL")
def reduceat(spark, d):
    return agg.reduceat(bindings.m(spark, d).residues.get_feature("c_acctbal"), [0, 10, 5, 20]).select("mol_id", "segment", F.round("result", 4).alias("result"))


@query("SELECT a.n_nationkey::BIGINT AS i, b.r_regionkey::BIGINT AS j, (a.n_nationkey * 10 + b.r_regionkey)::BIGINT AS result FROM nation a CROSS JOIN region b")
def outer(spark, d):
    mol = bindings.g(spark, d)
    a = mol.residues.joined().select("mol_id", "pos", (C("idx") * 10).alias("value"))
    return agg.outer(a, mol.chains.joined().select("mol_id", "pos", C("idx").alias("value")), "add").select("i", "j", "result")


@query(M_SQL + "SELECT mol_id, residue_idx, round(avg(o_totalprice), 6) AS result FROM ato GROUP BY ALL")
def ext_group_mean(spark, d):
    v = bindings.m(spark, d).atoms.joined().select("mol_id", "residue_idx", C("o_totalprice").alias("value"))
    return agg.aggregate(v, "mean", by=["mol_id", "residue_idx"]).select("mol_id", "residue_idx", F.round("result", 6).alias("result"))


# structure


@query(G_SQL + "SELECT idx, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN trunc(r + 0.75)::INT ELSE r END AS c_nationkey FROM cust")
def with_features(spark, d):
    v = bindings.g(spark, d).atoms.select(c_mktsegment="BUILDING")
    return v.with_features(c_acctbal=C("c_acctbal") + 1, c_nationkey=C("c_nationkey") + 0.75).get_container("atom").nodes.select("idx", "c_acctbal", "c_nationkey")


@query("SELECT c_custkey AS idx, c_acctbal * 2 AS twice FROM customer")
def update_features(spark, d):
    return bindings.g(spark, d).update_features("atom", twice=C("c_acctbal") * 2).get_container("atom").nodes.select("idx", "twice")


@query("SELECT c_custkey AS idx, c_custkey, c_nationkey, c_mktsegment FROM customer")
def remove_features(spark, d):
    out = bindings.g(spark, d).remove_features("atom", "c_acctbal", "c_name").get_container("atom")
    return out.nodes.select("idx", *out.node_keys())


X_SQL = M_SQL.rstrip() + """,
xa AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY idx) - 1 AS idx, residue_idx, chain_idx, o_orderkey, idx AS old FROM ato WHERE o_orderstatus = 'F'),
xr AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY first) - 1 AS idx, old FROM (SELECT mol_id, residue_idx AS old, min(idx) AS first FROM xa GROUP BY ALL)),
xc AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY first) - 1 AS idx, old FROM (SELECT mol_id, chain_idx AS old, min(idx) AS first FROM xa GROUP BY ALL))
"""


@query(X_SQL + "SELECT xa.mol_id, xa.idx, xr.idx AS residue_idx, xc.idx AS chain_idx, o_orderkey FROM xa JOIN xr ON xa.mol_id = xr.mol_id AND residue_idx = xr.old JOIN xc ON xa.mol_id = xc.mol_id AND chain_idx = xc.old")
def extract_atoms(spark, d):
    return bindings.m(spark, d).atoms.select(o_orderstatus="F").extract().get_container("atom").nodes.select("mol_id", "idx", "residue_idx", "chain_idx", "o_orderkey")


@query(X_SQL + "SELECT re.mol_id, xr.idx, xc.idx AS chain_idx, c_custkey FROM re JOIN xr ON re.mol_id = xr.mol_id AND re.idx = xr.old JOIN xc ON re.mol_id = xc.mol_id AND re.chain_idx = xc.old")
def extract_residues(spark, d):
    return bindings.m(spark, d).atoms.select(o_orderstatus="F").extract().get_container("residue").nodes.select("mol_id", "idx", "chain_idx", "c_custkey")


@query(X_SQL + "SELECT ch.mol_id, xc.idx, n_nationkey FROM ch JOIN xc ON ch.mol_id = xc.mol_id AND ch.idx = xc.old")
def extract_chains(spark, d):
    return bindings.m(spark, d).atoms.select(o_orderstatus="F").extract().get_container("chain").nodes.select("mol_id", "idx", "n_nationkey")


@query(X_SQL + "SELECT a.mol_id, a.old AS eid, a.idx AS src, b.idx AS dst, 'F' AS value FROM xa a JOIN xa b ON a.mol_id = b.mol_id AND b.old = a.old + 1")
def extract_edges(spark, d):
    return bindings.m(spark, d, edges=True).atoms.select(o_orderstatus="F").extract().get_container("atom")["next"].select("mol_id", "eid", "src", "dst", "value")


@query("SELECT n_nationkey::BIGINT AS idx, n_name FROM nation UNION ALL SELECT n_nationkey + 25, n_name FROM nation")
def container_concat(spark, d):
    c = bindings.g(spark, d).get_container("residue")
    return structure.concat_containers([c, c]).nodes.select("idx", "n_name")


@query(M_SQL + "SELECT row_number() OVER (ORDER BY ato.mol_id, ato.idx) - 1 AS idx, r.g AS residue_idx, o_orderkey FROM ato JOIN (SELECT mol_id, idx, row_number() OVER (ORDER BY mol_id, idx) - 1 AS g FROM re) r ON ato.mol_id = r.mol_id AND residue_idx = r.idx")
def mol_concat(spark, d):
    return structure.merge(bindings.m(spark, d)).get_container("atom").nodes.select("idx", "residue_idx", "o_orderkey")


@query("SELECT n_nationkey::BIGINT AS idx, n_regionkey::BIGINT AS chain_idx FROM nation UNION ALL SELECT n_nationkey + 25, n_regionkey + 5 FROM nation")
def mol_add(spark, d):
    g = bindings.g(spark, d)
    return (g + g).get_container("residue").nodes.select("idx", "chain_idx")


@query("SELECT max(n_regionkey)::BIGINT + 1 AS n_chain, count(*) AS n_residue FROM nation")
def index_from_parents(spark, d):
    g = bindings.g(spark, d)
    g.validate()
    return g.get_container("residue").nodes.agg((F.max("chain_idx") + 1).alias("n_chain"), F.count("*").alias("n_residue"))


@query(M_SQL + "SELECT re.mol_id, re.idx AS parent, (sum(count(ato.idx)) OVER w - count(ato.idx))::BIGINT AS \"start\", (sum(count(ato.idx)) OVER w)::BIGINT AS \"end\" FROM re LEFT JOIN ato ON ato.mol_id = re.mol_id AND residue_idx = re.idx GROUP BY re.mol_id, re.idx WINDOW w AS (PARTITION BY re.mol_id ORDER BY re.idx)")
def index_csr(spark, d):
    mol = bindings.m(spark, d)
    return csr(mol.get_container("atom").nodes, "residue_idx", mol.get_container("residue").nodes).select("mol_id", "parent", "start", "end")


@query(M_SQL + "SELECT re.mol_id, re.idx AS parent, coalesce(string_agg(ato.idx::VARCHAR, ',' ORDER BY ato.idx), '') AS children FROM re LEFT JOIN ato ON ato.mol_id = re.mol_id AND residue_idx = re.idx GROUP BY re.mol_id, re.idx")
def index_children(spark, d):
    mol = bindings.m(spark, d)
    found = csr(mol.get_container("atom").nodes, "residue_idx", mol.get_container("residue").nodes)
    return found.select("mol_id", "parent", F.array_join(F.transform(F.coalesce("children", F.expr("cast(array() as array<long>)")), lambda c: c.cast("string")), ",").alias("children"))


@query(G_SQL + "SELECT (eid + k * (SELECT max(eid) + 1 FROM fol))::BIGINT AS eid, (src + k * (SELECT count(*) FROM customer))::BIGINT AS src, (dst + k * (SELECT count(*) FROM customer))::BIGINT AS dst, value FROM fol, (VALUES (0), (1), (2)) t(k)")
def edge_concat3(spark, d):
    c = bindings.g(spark, d, edges=True).get_container("atom")
    return structure.concat_containers([c, c, c]).edges["follow"].select("eid", "src", "dst", "value")


@query("SELECT n_nationkey::BIGINT AS idx, n_name FROM nation")
def mol_copy(spark, d):
    return bindings.g(spark, d).copy().get_container("residue").nodes.select("idx", "n_name")


# codec


@query(M_SQL + "SELECT mol_id, idx, residue_idx, o_orderkey, o_totalprice FROM ato")
def dict_roundtrip(spark, d):
    return codec.from_dicts(codec.to_dicts(bindings.m(spark, d))).get_container("atom").nodes.select("mol_id", "idx", "residue_idx", "o_orderkey", "o_totalprice")


@query(M_SQL + "SELECT mol_id, idx, residue_idx, o_orderkey, o_totalprice FROM ato")
def bytes_roundtrip(spark, d):
    mol = bindings.m(spark, d)
    return codec.decode(codec.encode(mol), mol).get_container("atom").nodes.select("mol_id", "idx", "residue_idx", "o_orderkey", "o_totalprice")
