"""Dictionaries and compressed bytes of molecules.

The byte form: a zstd stream of the header's length (8 bytes, little-endian), a JSON header {template, arrays} and the arrays'
.npy buffers one after another.  Arrays are named by their place in the template.  ``to_bytes`` and ``load_bytes`` hold the whole
of it; ``encode`` and ``decode`` pass it on in parts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping
from functools import cache
from io import BytesIO
from itertools import chain, groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .molset import EDGE_COLUMNS, KEYS, Container, Level, MolSet

#: Nodes or edges that a task packs or unpacks at a time (a power of two), bytes of one part, and bytes of texts laid out at once.
BLOCK = 1 << 14
PART = 1 << 20
SLICE = 4 << 20


def to_bytes(data: Mapping[str, Any], level: int = 6) -> bytes:
    """Nested dictionaries of arrays and JSON values as bytes; object arrays are refused."""
    buffers: dict[str, bytes] = {}

    def strip(value: Any) -> Any:
        if isinstance(value, Mapping):
            return {k: strip(v) for k, v in value.items()}
        if not isinstance(value, np.ndarray):
            return value
        out = BytesIO()
        np.save(out, np.ascontiguousarray(value), allow_pickle=False)
        name = f"array:{len(buffers)}"
        buffers[name] = out.getvalue()
        return name

    template = strip(data)
    header = json.dumps({"template": template, "arrays": {k: len(v) for k, v in buffers.items()}}).encode()
    return zstandard.ZstdCompressor(level=level).compress(b"".join([len(header).to_bytes(8, "little"), header, *buffers.values()]))


def load_bytes(data: bytes) -> dict[str, Any]:
    """The inverse of ``to_bytes``; also reads streams without a content size."""
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    at = 8 + int.from_bytes(raw[:8], "little")
    header = json.loads(raw[8:at])
    arrays = {}
    for name, size in header["arrays"].items():
        arrays[name] = np.load(BytesIO(raw[at : at + size]), allow_pickle=False)
        at += size

    def fill(value: Any) -> Any:
        if isinstance(value, dict):
            return {k: fill(v) for k, v in value.items()}
        return arrays.get(value, value) if isinstance(value, str) else value

    return fill(header["template"])


def to_dicts(mol: MolSet) -> DataFrame:
    """A row for each molecule, with nested arrays of its nodes and edges, ordered by index; metadata goes along as JSON."""
    rows = None
    for lv, c in mol.containers.items():
        node = F.array_sort(F.collect_list(F.struct("idx", *(k for k in c.nodes.columns if k not in ("mol_id", "idx")))))
        df = c.nodes.groupBy("mol_id").agg(node.alias(lv.value))
        rows = df if rows is None else rows.join(df, "mol_id", "full")
        for key, e in c.edges.items():
            edge = e.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("eid", "src", "dst", "value"))).alias(f"{lv.value}:{key}"))
            rows = rows.join(edge, "mol_id", "left")
    return rows.withColumn("metadata", F.lit(json.dumps(mol.metadata)))


def from_dicts(rows: DataFrame) -> MolSet:
    """The inverse of ``to_dicts``."""
    containers = []
    for lv in Level:
        nodes = rows.select("mol_id", F.inline(lv.value))
        edges = {c.split(":", 1)[1]: rows.select("mol_id", F.inline(F.col(f"`{c}`"))) for c in rows.columns if c.startswith(f"{lv.value}:")}
        order = [*KEYS[lv], *(c for c in nodes.columns if c not in KEYS[lv])]
        containers.append(Container(lv, nodes.select(*order), edges))
    first = rows.select("metadata").first()
    return MolSet(*containers, json.loads(first[0]) if first else None)


def _tables(mol: MolSet) -> dict[str, tuple[DataFrame, str]]:
    """By name in the byte form, each level's and each edge feature's table and the column that orders it."""
    out = {}
    for lv, c in mol.containers.items():
        out[lv.value] = c.nodes.select("mol_id", "idx", *(k for k in c.nodes.columns if k not in ("mol_id", "idx"))), "idx"
        for key, e in c.edges.items():
            out[f"{lv.value}:{key}"] = e.select(*EDGE_COLUMNS), "eid"
    return out


def _flat(name: str, column: pa.Array) -> tuple[pa.Array, list[int], str, int]:
    """A column's values without nesting, the shape of one row, the NumPy type (U and S without width) and the widest text."""
    leaf, tail = column.type, []
    while pa.types.is_list(leaf) or pa.types.is_large_list(leaf):
        leaf = leaf.value_type
    while column.type != leaf and len(column):
        sizes = pc.unique(pc.list_value_length(column)).to_pylist()
        if len(sizes) > 1 or None in sizes:
            raise ValueError(f"Object arrays can't be saved: {name} has nulls or lists of several lengths")
        tail, column = tail + sizes, column.flatten()
    if column.null_count:
        raise ValueError(f"Object arrays can't be saved: {name} has nulls")
    if pa.types.is_string(leaf) or pa.types.is_large_string(leaf):
        return column, tail, "U", max(pc.max(pc.utf8_length(column)).as_py() or 0, 1)
    if pa.types.is_binary(leaf) or pa.types.is_large_binary(leaf):
        return column, tail, "S", max(pc.max(pc.binary_length(column)).as_py() or 0, 1)
    if not (pa.types.is_boolean(leaf) or pa.types.is_integer(leaf) or pa.types.is_floating(leaf)):
        raise ValueError(f"Object arrays can't be saved: {name} holds {leaf}")
    return column, tail, np.dtype(leaf.to_pandas_dtype()).str, 0


def _freeze(column: pa.Array) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.record_batch([column], names=["values"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _thaw(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def _cut(order: str, columns: list[str], first: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """One block of a table as a row a column, and before all of them (place -1) a row with their types and sizes."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order).combine_chunks()
        told, data = [], []
        for place, name in enumerate(columns, first):
            column, *kind = _flat(name, pa.concat_arrays(rows.column(name).chunks))
            told.append([place, rows.num_rows, *kind])
            data.append(_freeze(column))
        n = 1 + len(columns)
        places = [-1, *range(first, first + len(columns))]
        return pa.table({"mol_id": [key[0].as_py()] * n, "place": pa.array(places, pa.int32()), "block": [key[1].as_py()] * n, "data": pa.array([json.dumps(told).encode(), *data], pa.binary())})

    return run


def _npy_header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    out = BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue()


def _stream(rows: Iterator[tuple[int, bytes]], slots: list[tuple[str, str]], template: dict[str, Any]) -> Iterator[bytes]:
    """The byte form of one molecule before compression, from its blocks by place; what ``to_bytes`` compresses at once.  The
    first chunk is empty but for the total size, as text."""
    arrays: dict[int, list] = {}
    place, data = next(rows)
    while place < 0:
        for at, n, tail, kind, width in json.loads(data):
            own = arrays.setdefault(at, [0, tail, kind, width])
            if own[1] != tail:
                raise ValueError(f"Object arrays can't be saved: {slots[at][1]} has lists of several lengths")
            own[0], own[3] = own[0] + n, max(own[3], width)
        place, data = next(rows)
    types = {at: np.dtype(f"{kind}{width}" if kind in "US" else kind) for at, (_, _, kind, width) in arrays.items()}
    heads = {at: _npy_header(types[at], (arrays[at][0], *arrays[at][1])) for at in sorted(arrays)}
    sizes = {f"array:{k}": len(heads[at]) + types[at].itemsize * math.prod((arrays[at][0], *arrays[at][1])) for k, at in enumerate(heads)}
    template = {k: dict(v) if k != "metadata" else v for k, v in template.items()}
    for name, at in zip(sizes, heads, strict=True):
        template[slots[at][0]][slots[at][1]] = name
    header = json.dumps({"template": template, "arrays": sizes}).encode()
    yield str(8 + len(header) + sum(sizes.values())).encode()
    yield len(header).to_bytes(8, "little") + header
    last = -1
    for at, block in chain([(place, data)], rows):
        if at != last:
            yield heads[at]
            last = at
        column, dtype = _thaw(block), types[at]
        if dtype.kind not in "US":
            yield column.to_numpy(zero_copy_only=False).tobytes()
            continue
        step = max(SLICE // dtype.itemsize, 1)  # a wide text widens all of them
        for start in range(0, len(column), step):
            yield np.array(column.slice(start, step).to_pylist(), dtype).tobytes()


def encode(mol: MolSet, level: int = 6) -> DataFrame:
    """(mol_id, part, data): each molecule as bytes, cut into parts of about PART bytes; its parts in order, put together, are
    what ``to_bytes`` makes of its nested dictionary and ``load_bytes`` reads.

    A task packs BLOCK nodes or edges at a time; then one task a molecule passes its blocks, column by column, through one
    zstd stream.  So no task holds more than a block and a part, however large a molecule is.
    """
    slots: list[tuple[str, str]] = []
    pieces, tables = None, _tables(mol)
    for name, (table, order) in tables.items():
        columns = [c for c in table.columns if c != "mol_id"]
        blocks = table.withColumn("__block", F.shiftright(F.col(order).cast("long"), BLOCK.bit_length() - 1)).repartition("mol_id", "__block")
        cut = blocks.groupBy("mol_id", "__block").applyInArrow(_cut(order, columns, len(slots)), "mol_id long, place int, block long, data binary")
        slots += [(name, c) for c in columns]
        pieces = cut if pieces is None else pieces.unionByName(cut)
    template = {"metadata": mol.metadata, **{name: {} for name in tables}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m.as_py(), p.as_py(), d) for b in batches for m, p, d in zip(b.column("mol_id"), b.column("place"), b.column("data"), strict=True))
        for mol_id, own in groupby(rows, itemgetter(0)):
            chunks = _stream(((p, d.as_py()) for _, p, d in own), slots, template)
            packer = zstandard.ZstdCompressor(level=level).compressobj(size=int(next(chunks)))
            part, out = 0, bytearray()
            for chunk in chunks:
                out += packer.compress(chunk)
                if len(out) >= PART:
                    yield _part(mol_id, part, out)
                    part, out = part + 1, bytearray()
            yield _part(mol_id, part, out + packer.flush())

    return pieces.repartition("mol_id").sortWithinPartitions("mol_id", "place", "block").mapInArrow(run, "mol_id long, part long, data binary")


def _part(mol_id: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.record_batch({"mol_id": pa.array([mol_id], pa.int64()), "part": pa.array([part], pa.int64()), "data": pa.array([bytes(data)], pa.binary())})


class _Parts:
    """Parts of a stream as a file to read."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.left = parts, memoryview(b"")

    def read(self, size: int) -> bytes:
        while not self.left:
            part = next(self.parts, None)
            if part is None:
                return b""
            self.left = memoryview(part)
        out, self.left = self.left[:size], self.left[size:]
        return bytes(out)


def _exactly(file: Any, size: int) -> bytes:
    out = file.read(size)
    while len(out) < size:
        more = file.read(size - len(out))
        if not more:
            raise ValueError("the bytes of a molecule end too early")
        out += more
    return out


def _skip(file: Any, size: int) -> None:
    while size:
        size -= len(_exactly(file, min(size, SLICE)))


def _read_blocks(file: Any) -> Iterator[pa.Array]:
    """An .npy buffer as columns of at most BLOCK rows."""
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran or dtype.hasobject or not shape:
        raise ValueError(f"an array of {dtype}, shape {shape}, is no column")
    n, *tail = shape
    width = math.prod(tail)
    step = max(SLICE // max(dtype.itemsize * width, 1), 1)
    for start in range(0, n, BLOCK):
        slices, end = [], min(start + BLOCK, n)
        for at in range(start, end, step):
            raw = _exactly(file, min(step, end - at) * width * dtype.itemsize)
            values = np.frombuffer(raw, dtype) if raw else np.zeros(0, dtype)
            values = values.astype(dtype.newbyteorder("="), copy=False)
            slices.append(pa.array(values.tolist(), pa.string() if dtype.kind == "U" else pa.binary()) if dtype.kind in "US" else pa.array(values))
        column = pa.concat_arrays(slices)
        for k in reversed(range(len(tail))):
            rows = (end - start) * math.prod(tail[:k])
            column = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * tail[k], pa.int32()), column)
        yield column


def _read_table(wanted: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted parts the blocks of one table, a row a column; for "metadata" a row a molecule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((m.as_py(), d) for b in batches for m, d in zip(b.column("mol_id"), b.column("data"), strict=True))
        for mol_id, own in groupby(rows, itemgetter(0)):
            file = zstandard.ZstdDecompressor().stream_reader(_Parts(d.as_py() for _, d in own), read_across_frames=True)
            header = json.loads(_exactly(file, int.from_bytes(_exactly(file, 8), "little")))
            if wanted == "metadata":
                yield _block(mol_id, 0, "metadata", json.dumps(header["template"]["metadata"]).encode())
                continue
            columns = {v: k for k, v in header["template"].get(wanted, {}).items()}
            for name, size in header["arrays"].items():
                if name not in columns:
                    _skip(file, size)
                    continue
                for block, column in enumerate(_read_blocks(file)):
                    yield _block(mol_id, block, columns[name], _freeze(column))

    return run


def _block(mol_id: int, block: int, name: str, data: bytes) -> pa.RecordBatch:
    return pa.record_batch({"mol_id": pa.array([mol_id], pa.int64()), "block": pa.array([block], pa.int64()), "name": pa.array([name]), "data": pa.array([data], pa.binary())})


def decode(data: DataFrame, like: MolSet) -> MolSet:
    """The inverse of ``encode``; ``like`` gives the schema of the features.  ``data`` without ``part`` holds a molecule's whole
    stream in its row.  Like ``encode``, a task holds a block and a part; metadata is read when it is first asked for."""
    if "part" not in data.columns:
        data = data.withColumn("part", F.lit(0).cast("long"))
    parts = data.select("mol_id", "part", "data").repartition("mol_id").sortWithinPartitions("mol_id", "part")

    def read(wanted: str) -> DataFrame:
        return parts.mapInArrow(_read_table(wanted), "mol_id long, block long, name string, data binary")

    def table(name: str, model: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        order = [*keys, *(c for c in model.columns if c not in keys)]
        schema = T.StructType([T.StructField(c, model.schema[c].dataType) for c in order])

        def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(schema)
            own = {k: _thaw(v.as_py()) for k, v in zip(rows.column("name").to_pylist(), rows.column("data"), strict=True)}
            n = len(next(iter(own.values())))
            return pa.Table.from_arrays([pa.repeat(key[0], n) if c == "mol_id" else own[c].cast(target.field(c).type) for c in order], schema=target)

        return read(name).groupBy("mol_id", "block").applyInArrow(run, schema)

    @cache
    def metadata() -> dict:
        first = read("metadata").select("data").first()
        return json.loads(bytes(first[0])) if first else {}

    models = _tables(like)
    containers = []
    for lv, c in like.containers.items():
        edges = {k: table(f"{lv.value}:{k}", models[f"{lv.value}:{k}"][0], EDGE_COLUMNS) for k in c.edges}
        containers.append(Container(lv, table(lv.value, models[lv.value][0], KEYS[lv]), edges))
    return MolSet(*containers, metadata)


def write_tables(mol: MolSet, path: str) -> None:
    """Parquet tables, zstd, under ``path``: one for each level and edge feature, partitioned by nothing, sorted by molecule."""
    for lv, c in mol.containers.items():
        c.nodes.sortWithinPartitions("mol_id", "idx").write.option("compression", "zstd").parquet(f"{path}/{lv.value}")
        for key, e in c.edges.items():
            e.sortWithinPartitions("mol_id", "eid").write.option("compression", "zstd").parquet(f"{path}/{lv.value}.edge.{key}")


def read_tables(spark: SparkSession, path: str, edges: dict[str, list[str]] | None = None, metadata: dict | None = None) -> MolSet:
    """The set under ``path``; ``edges`` names the edge features of each level."""
    tables = [spark.read.parquet(f"{path}/{lv.value}") for lv in Level]
    edge_tables = {lv: {k: spark.read.parquet(f"{path}/{lv}.edge.{k}") for k in keys} for lv, keys in (edges or {}).items()}
    return MolSet.from_tables(*tables, edge_tables, metadata)
