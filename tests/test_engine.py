"""The engine against small NumPy statements of the same rules, and against SQL."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergrid import aggregate as agg
from tiergrid import catalogue, codec, errors, npsem, structure
from tiergrid.errors import FeatureOperationError, IndexInvalidError, IndexMismatchError, IndexOutOfBoundsError
from tiergrid.feature import Feature
from tiergrid.molset import CifMolSet, IndexTable, MolSet

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = db.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_text = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert as_text(got) == as_text(want)


@pytest.fixture(scope="module")
def mol(spark):
    """Five atoms, four residues (the last childless), three chains (the last childless), edges with a loop and parallels."""
    atoms = spark.createDataFrame([(0, i, r, i * 1.5 if i != 3 else float("nan"), e, [float(i), 2.0 * i]) for i, (r, e) in enumerate([(0, "C"), (0, "N"), (1, "C"), (1, "O"), (2, "C")])], "mol_id long, idx long, residue_idx long, charge double, element string, xyz array<double>")
    residues = spark.createDataFrame([(0, i, c, n) for i, (c, n) in enumerate([(0, "ALA"), (0, "GLY"), (1, "ALA"), (1, "SER")])], "mol_id long, idx long, chain_idx long, name string")
    chains = spark.createDataFrame([(0, i, n) for i, n in enumerate("ABC")], "mol_id long, idx long, id string")
    bond = spark.createDataFrame([(0, 0, 0, 1, "s"), (0, 1, 1, 2, "d"), (0, 2, 2, 2, "s"), (0, 3, 1, 2, "s"), (0, 4, 4, 0, "d")], "mol_id long, eid long, src long, dst long, value string")
    return MolSet.from_tables(atoms, residues, chains, {"atom": {"bond": bond}}, {"id": "x"}, validate=True)


def order(view):
    return [r["idx"] for r in view.df.orderBy("mol_id", "pos").collect()]


def test_order_and_duplicates(mol):
    v = mol.atoms.new([4, 2, 4, 0])
    assert order(v) == [4, 2, 4, 0] and order(v.unique()) == [4, 2, 0] and order(v.sort()) == [0, 2, 4, 4]
    assert order(v.to_residues()) == [2, 1, 2, 0] and order(v.residues) == [2, 1, 0] and order(v.to_chains()) == [1, 0, 1, 0]
    assert order(mol.residues.new([1, 3, 0, 1]).to_atoms()) == [2, 3, 0, 1, 2, 3]
    assert order(mol.chains.new([1, 0, 1]).to_residues()) == [2, 3, 0, 1, 2, 3] and order(mol.chains.new([2]).atoms) == []


@pytest.mark.parametrize("key", [slice(None), slice(1, 4), slice(None, None, -1), slice(-3, None, 2), slice(10, 0, -3), slice(-2, -9, -2), slice(3, 1)])
def test_slices(mol, key):
    base = [4, 2, 4, 0, 1]
    assert order(mol.atoms.new(base)[key]) == base[key]


def test_positions(mol):
    v = mol.atoms.new([4, 2, 0])
    assert order(v[-1]) == [0] and order(v[[2, 0, -1, 0]]) == [0, 4, 0, 4] and order(v[[True, False, True]]) == [4, 0]
    assert [order(x) for x in v] == [[4], [2], [0]]


def test_sets(mol):
    a, b = mol.atoms.new([4, 2, 4, 0]), mol.atoms.new([1, 2, 0, 1])
    assert order(a | b) == [4, 2, 0, 1] and order(a & b) == [2, 0] and order(a - b) == [4] and order(a ^ b) == [4, 1] and order(~a) == [1, 3]
    assert order(a + b) == [4, 2, 4, 0, 1, 2, 0, 1] and (a & b).is_subset(a) and not a.is_subset(b)


def test_select(mol):
    atoms = mol.atoms
    assert order(atoms.select(element="C")) == [0, 2, 4] and order(atoms.select(element=["N", "O"])) == [1, 3]
    assert order(atoms.select(charge=float("nan"))) == [] and order(atoms.select(element=1)) == [] and order(atoms.select(charge=[3, "x"])) == []
    assert order(atoms.new([2, 3, 2]).select(bond="s")) == [2, 2] and order(atoms.select(bond=["d"], element="C")) == [0, 2, 4]
    assert atoms.select() is atoms
    with pytest.raises(errors.FeatureKeyError):
        atoms.select(name="ALA")
    with pytest.raises(errors.FeatureOperationError):
        atoms.select(xyz=1.0)


def test_crop_takes_first_places(mol):
    rows = mol.atoms.new([2, 1, 2]).get_feature("bond").orderBy("eid").collect()
    assert [(r["src"], r["dst"], r["value"]) for r in rows] == [(1, 0, "d"), (0, 0, "s"), (1, 0, "s")]


def test_extract(mol):
    out = mol.atoms.new([4, 2, 4, 1]).extract()
    atoms = out.get_container("atom").nodes.orderBy("idx").collect()
    assert [(r["residue_idx"], r["chain_idx"], r["charge"]) for r in atoms] == [(0, 0, 6.0), (1, 1, 3.0), (2, 1, 1.5)]
    assert [r["name"] for r in out.get_container("residue").nodes.orderBy("idx").collect()] == ["ALA", "GLY", "ALA"]
    assert out.metadata is mol.metadata and len(out.get_container("chain")) == 2
    with pytest.raises(errors.IndexInvalidError):
        structure.extract(mol.chains.new([2]), validate=True)


def test_with_features_last_wins_and_casts(mol, spark):
    v = mol.atoms.new([1, 2, 1])
    value = spark.createDataFrame([(0, 0, 7.0), (0, 1, 8.0), (0, 2, 9.0)], "mol_id long, pos long, value double")
    got = [r["charge"] for r in v.with_features(charge=value).get_container("atom").nodes.orderBy("idx").collect()]
    assert got[1:3] == [9.0, 8.0] and got[0] == 0.0
    with pytest.raises(errors.FeatureOperationError):
        v.with_features(bond=F.lit(1))


def test_concat_moves_everything(mol):
    two = mol + mol
    assert [len(two.get_container(k)) for k in ("atom", "residue", "chain")] == [10, 8, 6]
    edges = two.get_container("atom")["bond"].orderBy("eid").collect()
    assert [(r["src"], r["dst"]) for r in edges[5:]] == [(5, 6), (6, 7), (7, 7), (6, 7), (9, 5)]
    two.validate()
    assert two.metadata == mol.metadata and two.metadata is not mol.metadata
    with pytest.raises(ValueError, match="nothing"):
        structure.concat([])
    with pytest.raises(errors.FeatureKeyError):
        structure.concat_containers([mol.get_container("chain"), mol.get_container("chain").update(x=F.lit(1))])


def test_views_of_other_sets_dont_mix(mol):
    with pytest.raises(errors.ViewOperationError):
        mol.atoms + mol.copy().atoms
    with pytest.raises(errors.ViewOperationError):
        mol.atoms & mol.residues
    with pytest.raises(errors.IndexOutOfBoundsError):
        mol.atoms.new([5])
    with pytest.raises(errors.IndexInvalidError):
        mol.atoms.new([[0]])
    with pytest.raises(errors.StructureLevelError):
        mol.get_container("bond")


def test_containers(mol):
    c = mol.get_container("atom")
    assert c.keys() == ["charge", "element", "xyz", "bond"] and "bond" in c and "x" not in c
    with pytest.raises(errors.FeatureKeyError):
        c.remove("x")
    with pytest.raises(errors.FeatureKeyError):
        c.remove("charge", "element", "xyz")
    assert repr(mol) == "<MolSet with 5 atoms, 4 residues, and 3 chains>"


def test_validation(spark, mol):
    chain = mol.get_container("chain").nodes
    bad = spark.createDataFrame([(0, 0, 9, "A")], "mol_id long, idx long, chain_idx long, name string")
    atom = spark.createDataFrame([(0, 0, 0, 9, "C")], "mol_id long, idx long, residue_idx long, chain_idx long, element string")
    with pytest.raises(errors.IndexOutOfBoundsError):
        MolSet.from_tables(atom, bad, chain, validate=True)


def test_aggregates_follow_numpy(mol):
    v = mol.atoms.get_feature("charge")
    assert np.isnan(agg.aggregate(v, "min").first()["result"]) and np.isnan(agg.aggregate(v, "max").first()["result"])
    empty = v.where(F.lit(False))
    assert np.isnan(agg.aggregate(empty, "mean").first()["result"]) and agg.aggregate(empty, "sum").first()["result"] == 0
    with pytest.raises(Exception, match="no elements"):
        agg.aggregate(empty, "min").collect()
    xyz = np.array([[i, 2.0 * i] for i in range(5)])
    got = mol.atoms.get_feature("xyz")
    assert agg.aggregate(got, "mean", axis=0).first()["result"] == xyz.mean(axis=0).tolist() == agg.aggregate(got, "mean", axis=0, width=2).first()["result"]
    assert agg.aggregate(got, "sum").first()["result"] == xyz.sum()
    assert [r["result"] for r in agg.reduceat(got.select("mol_id", "pos", F.col("value")[0].alias("value")), [0, 3, 1]).orderBy("segment").collect()] == np.add.reduceat(xyz[:, 0], [0, 3, 1]).tolist()


UNARY = "negative positive reciprocal square sqrt cbrt absolute fabs sign signbit exp exp2 expm1 log log2 log10 log1p sin cos tan sinh cosh tanh arcsin arccos arctan arcsinh arccosh arctanh degrees radians floor ceil trunc rint logical_not isnan isinf isfinite conj spacing".split()
BINARY = "floor_divide remainder add subtract multiply divide fmod power copysign heaviside logaddexp logaddexp2 arctan2 hypot maximum minimum fmax fmin equal not_equal less less_equal greater greater_equal logical_and logical_or logical_xor nextafter".split()
VALUES = [0.0, 1.0, -1.0, 0.5, -2.5, 3.0, 1e6, float("nan"), float("inf"), float("-inf")]


def close(a, b):
    a, b = float(a), float(b)
    return (np.isnan(a) and np.isnan(b)) or a == b or bool(np.isclose(a, b, rtol=1e-12, atol=0))


@pytest.mark.parametrize("name", UNARY)
def test_unary_ufuncs(spark, name):
    values = [v for v in VALUES if np.isfinite(v) or name != "spacing"] + [1e300, -1e300, -0.5]
    df = spark.createDataFrame([(v,) for v in values], "a double").coalesce(1)
    got = [r[0] for r in df.select(npsem.UFUNCS[name](F.col("a"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(np.array(values))
    assert [(v, g, w) for v, g, w in zip(values, got, want, strict=True) if g is None or not close(g, w)] == []


@pytest.mark.parametrize("name", BINARY)
def test_binary_ufuncs(spark, name):
    values = VALUES if name not in ("nextafter", "logaddexp", "logaddexp2", "power") else [v for v in VALUES if np.isfinite(v)]
    pairs = [(a, b) for a in values for b in values if not (name == "nextafter" and a == 0)]
    df = spark.createDataFrame(pairs, "a double, b double").coalesce(1)
    got = [r[0] for r in df.select(npsem.ufunc(name, [T.DoubleType()] * 2)(F.col("a"), F.col("b"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(*np.array(pairs).T)
    assert [(p, g, w) for p, g, w in zip(pairs, got, want, strict=True) if g is None or not close(g, w)] == []


@pytest.mark.parametrize("name", "floor_divide mod gcd lcm bitwise_and bitwise_or bitwise_xor".split())
def test_integer_ufuncs(spark, name):
    pairs = [(a, b) for a in (-7, -6, 0, 1, 5, 12) for b in (-3, 0, 2, 5)]
    df = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    got = [r[0] for r in df.select(npsem.UFUNCS[name](F.col("a"), F.col("b"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(*np.array(pairs).T)
    assert got == want.tolist()


BIG = 2**53 + 1


@pytest.mark.parametrize("name", "floor_divide mod fmod maximum minimum equal not_equal less greater_equal power".split())
def test_whole_numbers_are_exact(spark, name):
    pairs = [(a, b) for a in (BIG, BIG - 1, -BIG, 7, -7, 0, 1, -1) for b in (BIG, 3, -3, 0, 1) if name != "power" or (0 <= b <= 3 and abs(a) < BIG - 1)]
    df = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    got = [r[0] for r in df.select(npsem.ufunc(name, [T.LongType()] * 2)(F.col("a"), F.col("b"))).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(*np.array(pairs).T)
    assert got == want.tolist()


def test_whole_powers_refuse_negative_exponents(spark):
    df = spark.createDataFrame([(3, -1)], "a long, b long").select(npsem.ufunc("power", [T.LongType()] * 2)(F.col("a"), F.col("b")))
    with pytest.raises(Exception, match="negative integer powers"):
        df.collect()


def node_feature(spark, values, kind="long"):
    return Feature(spark.createDataFrame([(0, i, i, v) for i, v in enumerate(values)], f"mol_id long, pos long, idx long, value {kind}"))


def test_feature_operators(spark):
    data = [4, -7, 0, BIG]
    f, a = node_feature(spark, data), np.array(data)
    for made, want in ((f + 1, a + 1), (2 - f, 2 - a), (f // 2, a // 2), (f % -3, a % -3), (-f, -a), (abs(f), abs(a)), (f & 5, a & 5), (f / 2, a / 2), (f * f, None), (~f, ~a)):
        if want is not None:
            assert isinstance(made, Feature) and made.asarray().tolist() == want.tolist()
    for made, want in ((f == BIG - 1, a == BIG - 1), (f < 1, a < 1), (f != 0, a != 0)):
        assert [r["result"] for r in made.orderBy("pos").collect()] == want.tolist()
    q, r = divmod(f, 3)
    assert q.asarray().tolist() == (a // 3).tolist() and r.asarray().tolist() == (a % 3).tolist()
    assert f[[1, 1, -1]].asarray().tolist() == [-7, -7, BIG] and f[1:3].asarray().tolist() == [-7, 0] and f[2].asarray().tolist() == [0] and f[F.col("value") > 0].asarray().tolist() == [4, BIG]
    assert f.min().first()["result"] == -7 and f.max().first()["result"] == BIG and len(f) == 4 and f.shape == (4,) and f.ndim == 1
    with pytest.raises(FeatureOperationError):
        bool(f)
    with pytest.raises(FeatureOperationError):
        f += 1
    with pytest.raises(FeatureOperationError):
        f.at([0])
    xyz = node_feature(spark, [[1.0, 2.0], [3.0, 5.0]], "array<double>")
    assert (xyz * [2.0, 10.0]).asarray().tolist() == [[2.0, 20.0], [6.0, 50.0]] and (1 + xyz).asarray().tolist() == [[2.0, 3.0], [4.0, 6.0]] and (xyz - xyz).asarray().tolist() == [[0.0, 0.0]] * 2 and xyz.ndim == 2


def test_edge_features_keep_their_ends(spark):
    e = Feature(spark.createDataFrame([(0, 0, 5, 6, 1.5), (0, 1, 6, 5, float("nan")), (0, 2, 5, 9, -1.0)], "mol_id long, eid long, src long, dst long, value double"))
    assert [(r["src"], r["dst"], r["value"]) for r in (e + 1)[[2, 0]].df.orderBy("eid").collect()] == [(5, 9, 0.0), (5, 6, 2.5)]
    assert [r["idx"] for r in e.nodes().collect()] == [5, 6, 9]
    with pytest.raises(IndexInvalidError):
        e[0]
    with pytest.raises(FeatureOperationError):
        e + node_feature(spark, [1])


def test_running_minimum_keeps_nan(spark):
    f = node_feature(spark, [2.0, float("nan"), 1.0], "double")
    got = [r["result"] for r in agg.accumulate(f.df, "minimum").orderBy("pos").collect()]
    assert got[0] == 2.0 and np.isnan(got[1]) and np.isnan(got[2])


def test_index_table(spark):
    t = IndexTable.from_parents(spark, [0, 0, 1, 1, 2], [0, 0, 1])
    idx = lambda df: [r["idx"] for r in df.orderBy("pos").collect()]
    assert idx(t.convert([0, 2, 4], "atom", "residue")) == [0, 1, 2] and idx(t.convert([0, 2], "residue", "chain")) == [0, 1] and idx(t.convert([0, 1], "chain", "residue")) == [0, 1, 2] and idx(t.convert([1, 0], "atom", "atom")) == [1, 0]
    assert IndexTable.from_parents(spark, [0], [0, 1], 5).mol.chains.df.count() == 5
    for atoms, residues, n, error in (([], [0], None, IndexInvalidError), ([-1], [0], None, IndexInvalidError), ([1], [0], None, IndexOutOfBoundsError), ([0], [1], 1, IndexOutOfBoundsError)):
        with pytest.raises(error):
            IndexTable.from_parents(spark, atoms, residues, n)
    assert t.children("chain").count() == 2 and t.children("residue").count() == 3


def test_concat_refuses_sets_of_several_molecules(mol, spark):
    one = IndexTable.from_parents(spark, [0], [0]).mol
    two = one.replace("chain", one.containers["chain"].update())
    several = MolSet(*(type(c)(c.level, c.nodes.unionByName(c.nodes.withColumn("mol_id", F.lit(1).cast("long")))) for c in one.containers.values()))
    with pytest.raises(IndexMismatchError):
        two + several


def test_wrap(spark):
    df = spark.createDataFrame([(2**62,)], "a long").select(npsem.wrap(F.col("a").cast("decimal(38,0)") * 3, 64).alias("w"))
    with np.errstate(all="ignore"):
        assert df.first()["w"] == int((np.array([2**62]) * 3)[0])


def test_bytes(tmp_path):
    data = {"atoms": {"coord": np.arange(6, dtype=np.float32).reshape(2, 3), "e": np.array(["C", "N"])}, "n": 42, "s": "test", "empty": np.zeros(0), "deep": {"i": np.arange(3, dtype=np.int32).reshape(1, 3, 1)}}
    back = codec.load_bytes(codec.to_bytes(data))
    assert back["n"] == 42 and back["s"] == "test" and back["atoms"]["coord"].dtype == np.float32 and back["deep"]["i"].shape == (1, 3, 1) and back["empty"].shape == (0,)
    np.testing.assert_array_equal(back["atoms"]["e"], data["atoms"]["e"])
    with pytest.raises(ValueError, match="Object arrays"):
        codec.to_bytes({"x": np.array([object()])})


@pytest.fixture(scope="module")
def large(spark):
    """Two molecules over several blocks and parts, with texts, booleans and nested lists; the second has no chains and no edges."""
    n = 4 * codec.BLOCK + 1000
    atoms = spark.range(n * 2).select((F.col("id") % 2).alias("mol_id"), F.floor(F.col("id") / 2).alias("idx"), F.lit(0).cast("long").alias("residue_idx"), F.lit(0).cast("long").alias("chain_idx"), F.rand(7).alias("q"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("\u00e9\U0001f600"), "id")).alias("s"), F.col("id").cast("int").alias("i"), (F.col("id") % 5 == 0).alias("b"), F.array(F.array(F.rand(8), F.rand(9)), F.array(F.rand(10), F.lit(0.5))).alias("xy"))
    atoms = atoms.localCheckpoint()
    residues = spark.createDataFrame([(0, 0, 0, "A"), (1, 0, 0, "B")], "mol_id long, idx long, chain_idx long, name string")
    chains = spark.createDataFrame([(0, 0, 1.5)], "mol_id long, idx long, w double")
    bond = atoms.where("mol_id = 0").select("mol_id", F.col("idx").alias("eid"), F.col("idx").alias("src"), F.lit(0).cast("long").alias("dst"), "q").withColumnRenamed("q", "value")
    return MolSet.from_tables(atoms, residues, chains, {"atom": {"bond": bond}}, {"id": "x", "deep": {"n": 1}})


def test_large_molecules_as_bytes_in_parts(large, spark):
    rows = codec.encode(large).orderBy("mol_id", "part").collect()
    for m in (0, 1):
        own = [r for r in rows if r["mol_id"] == m]
        assert len(own) > 1 and [r["part"] for r in own] == list(range(len(own))) and max(len(r["data"]) for r in own) <= codec.PART + codec.SLICE
        whole = b"".join(r["data"] for r in own)
        data = codec.load_bytes(whole)
        assert data["metadata"] == {"id": "x", "deep": {"n": 1}} and list(data) == ["metadata", "atom", "atom:bond", "residue", "chain"]
        want = large.containers["atom"].nodes.where(F.col("mol_id") == m).orderBy("idx").toPandas()
        for k, v in data["atom"].items():
            np.testing.assert_array_equal(v, np.array(want[k].map(lambda x: np.stack(x) if k == "xy" else x).tolist()))  # noqa: B023
        assert data["atom"]["xy"].shape == (len(want), 2, 2) and data["atom"]["i"].dtype == np.int32 and data["atom"]["b"].dtype == bool and (data["chain"] == {}) == (m == 1)
        raw = [zstandard.ZstdDecompressor().decompress(x) for x in (whole, codec.to_bytes(data))]
        assert raw[0] == raw[1]  # the very stream that to_bytes compresses at once
    back = codec.decode(spark.createDataFrame([tuple(r) for r in rows], "mol_id long, part long, data binary"), large)
    assert back.metadata == large.metadata
    for lv, c in large.containers.items():
        other = back.containers[lv]
        for a, b in ((c.nodes, other.nodes), *((e, other.edges[k]) for k, e in c.edges.items())):
            b = b.select(a.columns)
            assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema] and a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_bytes_are_read_a_block_at_a_time():
    """A molecule whose idx column expands to 64 MB out of a small part: what is held stays under a quarter of it."""
    n = 1 << 23
    whole = codec.to_bytes({"metadata": {}, "atom": {"idx": np.zeros(n, np.int64)}})
    batch = pa.record_batch({"mol_id": pa.array([0], pa.int64()), "part": pa.array([0], pa.int64()), "data": pa.array([whole], pa.binary())})
    before, rows, held = pa.total_allocated_bytes(), 0, 0
    tracemalloc.start()
    for out in codec._read_table("atom")(iter([batch])):
        rows += len(codec._thaw(out.column("data")[0].as_py()))
        held = max(held, pa.total_allocated_bytes() - before)
    held += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and held < 2 * n


def test_bytes_in_one_row_and_refused_columns(mol, spark):
    node = {"idx": np.arange(2), "residue_idx": np.zeros(2, int), "chain_idx": np.zeros(2, int), "charge": np.array([0.5, np.nan]), "element": np.array(["C", ""]), "xyz": np.ones((2, 3))}
    rows = spark.createDataFrame([(7, bytearray(codec.to_bytes({"metadata": {"k": 1}, "atom": node, "residue": {}, "chain": {}})))], "mol_id long, data binary")
    back = codec.decode(rows, mol)
    got = back.containers["atom"].nodes.orderBy("idx").collect()
    assert [(r["mol_id"], r["idx"], r["element"], r["xyz"]) for r in got] == [(7, 0, "C", [1.0] * 3), (7, 1, "", [1.0] * 3)] and got[0]["charge"] == 0.5 and np.isnan(got[1]["charge"])
    assert back.metadata == {"k": 1} and back.containers["residue"].nodes.isEmpty()
    for bad in (F.when(F.col("idx") > 0, F.col("charge")), F.sequence(F.lit(0), F.col("idx")), F.current_date()):
        with pytest.raises(Exception, match="Object arrays"):
            codec.encode(mol.update_features("atom", bad=bad)).count()


def test_tables_round_trip(mol, spark, tmp_path):
    codec.write_tables(mol, f"file://{tmp_path}/m")
    back = codec.read_tables(spark, f"file://{tmp_path}/m", {"atom": ["bond"]}, {"id": "x"})
    assert order(back.atoms.select(bond="d")) == order(mol.atoms.select(bond="d"))


def test_preset(mol):
    c = CifMolSet(*mol.containers.values(), {"id": "1abc", "assembly_id": "1", "model_id": 2, "alt_id": "A"})
    assert (c.id, c.assembly_id, c.model_id, c.alt_id) == ("1abc", "1", 2, "A") and ("atom", "xyz") not in c.missing_features() and ("chain", "contact") in c.missing_features()
