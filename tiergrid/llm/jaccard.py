"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents become sets of word shingles.  Two sets link when ``den * |x & y| >= num * |x | y|``, which asks for
T common shingles, T following from the sizes.  DivideSkip parts the inverted lists of a set's
shingles into long and short ones: the L = T - OCCURRENCES most frequent shingles have the long lists, T being that of
the smallest partner, the others the short ones.  Short lists are stored, and heap-merged; a partner must occur
on T - L of them, with the T of both sizes.  Whether a candidate stands on enough of the long lists is probed by binary
search in its own sorted set, which is those lists read the other way round, until T is reached or out of reach.

All texts are hashed twice, once for digests and counts and once for short lists; the sets of those documents alone that
a pair asks to verify are made again, so no table is larger than the texts.  What keeps the rest linear where texts repeat:

* equal sets are one class, found by a digest; copies never meet;
* a pair of Bloom filters drops the short-list shingles that only one class holds, before any shuffle;
* near copies are first tied to one leader for each least hash, the document with the fewest rare shingles, as
  the text from which copies were edited has (pairs that a sketch lets through, each link verified); later only pairs under different leaders
  are sought, for only they can join components.  A group of near copies so costs a row a document;
* lists are kept by (shingle, chunk), and sets that look for partners by (shingle, block).  Of two sets under
  different leaders one at least isn't under the leader that most of a list has, so only the others look.  A block meets
  a chunk in one row, and the sketch, 32 bytes that bound the difference of two sets exactly from below, picks
  the pairs that leave the task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import as_bytes, arrow_map, materialise, pack, release, small_batches, spread_join, tidy
from .graph import components
from .shingles import mix, shingle_sets

#: Counters of shingles, by the first bits of their hashes; each task holds one table of 4 bytes a counter.
COUNTERS, COUNTER_ROWS = 1 << 20, 64
#: Documents in a chunk of an inverted list, and in a block of sets that look for partners, in the mean.
LIST_CHUNK, QUERY_BLOCK = 2048, 512
#: Pairs that a task compares at once.
PAIRS_AT_ONCE = 1 << 19
#: Most rounds of ties, and the share of leaders that a round must tie for another to follow.
LEADER_ROUNDS, LEAST_TIED = 4, 0.01
#: Short lists that a partner must be on, where the sets are large enough to ask for as many.
OCCURRENCES = 3
#: The same for the lists that hold the smaller set of a pair; fewer make them shorter, and the partner is on fewer.
INDEXED = 1
#: Bits of a set's sketch.
SKETCH_BITS = 256

_SALTS = np.random.default_rng(20240301).integers(1, 1 << 63, LEADER_ROUNDS, np.uint64)


def required(a: int, b: int, num: int, den: int) -> int:
    """The least overlap with which sets of these sizes link."""
    return -(-num * (a + b) // (num + den))


def least_partner(a: int, num: int, den: int) -> int:
    return -(-num * a // den)


def occurrences(a: int, num: int, den: int) -> int:
    """Short lists of a set of this size that its smallest partner must be on."""
    return min(OCCURRENCES, least_partner(a, num, den))


def least_shared(a: int, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Short lists that a set of size ``a`` and one of each size in ``b`` must share to link: T less the long lists.

    All sets follow one order of shingles, so the set whose short lists end first has all it shares there on short
    lists of the other too; what else it shares is at most its own long lists.
    """
    b = np.asarray(b, np.int64)
    longs = [n - np.minimum(OCCURRENCES, n) for n in (-(-num * a // den), -(-num * b // den))]
    return -(-num * (a + b) // (num + den)) - np.maximum(*longs)


def indexed(a: int, num: int, den: int) -> int:
    """How many of a set's rarest shingles have it on their lists for partners at least as large: L is that of T for
    two sets of this size."""
    t = required(a, a, num, den)
    return a - t + min(INDEXED, t)


def least_listed(a: int, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """As ``least_shared``, counting only the lists that hold the smaller set, of size ``b``, among its indexed ones."""
    b = np.asarray(b, np.int64)
    most, t = -(-num * a // den), -(-num * (b + b) // (num + den))
    longs = (most - min(OCCURRENCES, most), t - np.minimum(INDEXED, t))
    return -(-num * (a + b) // (num + den)) - np.maximum(*longs)


class Ranks:
    """Counts of shingles by the first bits of their hashes; orders a set from rare to frequent."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def order(self, shingles: np.ndarray) -> np.ndarray:
        return shingles[np.argsort(self.counts[counter(shingles)], kind="stable")]

    def short(self, shingles: np.ndarray, num: int, den: int) -> np.ndarray:
        """The shingles of the short lists: all but the L most frequent, T for the smallest partner."""
        n = len(shingles)
        return self.order(shingles)[: n - least_partner(n, num, den) + occurrences(n, num, den)]


def counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def merge_short(lists: list[Iterable[tuple[int, ...]]], least: int = 1) -> np.ndarray:
    """Each entry (id, size, ...) and how many of the sorted lists hold it, if ``least`` of them do, by a heap merge."""
    rows: list[tuple[int, ...]] = []
    last, count = None, 0
    for x in heapq.merge(*lists):
        if x == last:
            count += 1
            continue
        if count >= least:
            rows.append((*last, count))
        last, count = x, 1
    if count >= least:
        rows.append((*last, count))
    width = len(rows[0]) if rows else 5
    return np.array(rows, np.int64).reshape(-1, width)


def sketch(shingles: np.ndarray) -> bytes:
    """One bit for each residue of the shingles' hashes: whether an odd number of them has it.

    Where two sketches differ, the sets differ too, so the bits that differ number at most as many as the shingles.
    """
    odd = np.bincount((mix(shingles) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each sketch of ``b`` (rows of 64-bit words), a count that the difference of the sets can't be below."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def reaches(x: np.ndarray, y: np.ndarray, need: int, block: int = 512) -> bool:
    """Whether sorted ``x`` and ``y`` share ``need`` items; probes the longer by binary search, in blocks,
    and stops when that is certain either way."""
    if len(x) > len(y):
        x, y = y, x
    have = 0
    for start in range(0, len(x), block):
        if have + len(x) - start < need:
            return False
        part = x[start : start + block]
        at = np.minimum(np.searchsorted(y, part), len(y) - 1)
        have += int((y[at] == part).sum())
        if have >= need:
            return True
    return have >= need


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingle_sets(as_bytes(batch.column("text")), k)


def _arrays(column: pa.Array, dtype: type = np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, max_bits: int) -> DataFrame:
    """The pairs (x, y, and what else they hold) that link.

    Sets are made anew from the texts of those documents alone that stand in a pair, which a Bloom filter of
    their ids picks while the texts are read.
    """
    names = pairs.columns
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id"))
    wanted = pairs.sparkSession.sparkContext.broadcast(bloom.member_filter(ids, "doc_id", "jaccard-wanted", max_bits))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(wanted.value.contains(bloom.hash_ids(batch.column("doc_id").to_numpy())), pa.bool_()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pack(_sets(batch, k))], names=["doc_id", "shingles"])

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = [reaches(a, b, required(len(a), len(b), num, den)) for a, b in zip(_arrays(batch.column("x_set")), _arrays(batch.column("y_set")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).filter(pa.array(linked, pa.bool_()))

    sets = materialise(arrow_map(docs, make, "doc_id long, shingles binary").where("length(shingles) > 0"), "jaccard-wanted")
    full = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("x_set")), "x")
    full = spread_join(full, sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("y_set")), "y", weigh=pairs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    out = materialise(arrow_map(full.select(*names, "x_set", "y_set"), check, schema).distinct(), "jaccard-verified")
    wanted.unpersist()
    release(sets)
    return out


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """Components of documents that link by the Jaccard similarity of their word shingles.

    Returns one row for each input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that
    links reach, itself included).  The defaults take five words and a similarity of 0.8.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; fewer than ``k`` words are one shingle.
    Documents without words, or with a null text, have the empty set, link with nothing and are their own
    component.  Rows that share an id are one document that links through any of its texts.  Rows with a null
    id link with nothing; their component is null.  Ids are whole numbers.  Extra columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    known = docs.where("doc_id is not null")

    first = materialise(docs.mapInArrow(tidy(_measure(k)), "doc_id long, n long, sig binary, slot int, counts binary"), "jaccard-sets")
    rows = first.where("sig is not null").select("doc_id", "n", "sig")
    classes = materialise(rows.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    ranks = spark.sparkContext.broadcast(_ranks(first))
    first_ids = spark.sparkContext.broadcast(bloom.member_filter(classes, "rep", "jaccard-reps", max_bits))

    def short_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents but copies, save a few that the filter lets through and that link to their class."""
        batch = batch.filter(pa.array(first_ids.value.contains(bloom.hash_ids(batch.column("doc_id").to_numpy())), pa.bool_()))
        sets = _sets(batch, k)
        some = [r for r, s in enumerate(sets) if len(s)]
        sets = [sets[r] for r in some]
        marks = [[int(mix(s ^ salt).min().view(np.int64)) for salt in _SALTS] for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(some, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pack([ranks.value.short(s, num, den) for s in sets]), pa.array(marks, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())],
            names=["doc_id", "n", "tokens", "marks", "sketch"],
        )

    short = materialise(arrow_map(known, short_lists, "doc_id long, n long, tokens binary, marks array<long>, sketch binary"), "jaccard-short")
    hashes = lambda batch: bloom.packed_rows(np.concatenate([np.zeros(0, np.uint64), *_arrays(batch.column("tokens"))]))
    twice = spark.sparkContext.broadcast(bloom.twice_filter(arrow_map(short.select("tokens"), hashes, bloom.PACKED), "jaccard", max_bits))

    def keep_active(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents with enough shingles on short lists that may hold another document."""
        every = _arrays(batch.column("tokens"))
        hits = twice.value.contains(np.concatenate([np.zeros(0, np.uint64), *every]))
        kept, rare, own, lead = [], [], [], []
        at = 0
        for r, (t, n) in enumerate(zip(every, batch.column("n").to_pylist(), strict=True)):
            hit = hits[at : at + len(t)]
            at += len(t)
            if int(hit.sum()) >= occurrences(least_partner(n, num, den), num, den):
                kept.append(r)
                rare.append(len(t) - int(hit.sum()))
                own.append(t[hit])
                lead.append(int(hit[: indexed(n, num, den)].sum()))
        rest = batch.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("doc_id", "n", "marks", "sketch")), pa.array(rare, pa.int64()), pack(own), pa.array(lead, pa.int64())], names=["doc_id", "n", "marks", "sketch", "rare", "tokens", "lead"])

    active = materialise(arrow_map(short, keep_active, "doc_id long, n long, marks array<long>, sketch binary, rare long, tokens binary, lead long"), "jaccard-active")
    release(short)
    for sent in (twice, ranks, first_ids):
        sent.unpersist()

    verify = lambda pairs: _verify(pairs, known, k, num, den, max_bits)
    labels = _tie(active, verify, num, den)
    candidates = _cross_candidates(active, labels, num, den)
    links = verify(candidates).select(F.col("label").alias("a"), F.col("other").alias("b")).distinct()

    release(active)

    member = spread_join(rows.where("n > 0 and doc_id is not null"), classes, "sig").select("doc_id", "n", "rep")
    member = materialise(spread_join(member, labels.select(F.col("doc_id").alias("rep"), "label"), "rep", how="left").select("doc_id", "n", F.coalesce("label", "rep").alias("label")), "jaccard-members")
    # rows that share an id, in several classes, join those
    ends = member.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("doc_id", "a")
    links = links.unionByName(member.join(ends, "doc_id").where("a <> label").select("a", F.col("label").alias("b")).distinct())
    parts = components(links).withColumnRenamed("node", "label")
    rooted = spread_join(member, parts, "label", how="left").select("doc_id", "n", F.coalesce("component", "label").alias("root"))
    rooted = materialise(rooted, "jaccard-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = spread_join(rooted, least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _measure(k: int):
    """For ``mapInArrow``: the size and digest of each document's set, and at the end the counts of the task's shingles in COUNTER_ROWS rows."""
    names = ["doc_id", "n", "sig", "slot", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sets = _sets(batch, k)
            none = pa.nulls(len(sets))
            if any(map(len, sets)):
                where, times = np.unique(counter(np.concatenate(sets)), return_counts=True)
                counts[where] += times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=names,
            )
        if counts.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, COUNTER_ROWS)]
            none = pa.nulls(COUNTER_ROWS)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(COUNTER_ROWS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _ranks(first: DataFrame) -> Ranks:
    """The tasks' counts, added up slot by slot; 4 MB come to the driver, at any size of input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, packed in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint32)
                total = sums.setdefault(slot, np.zeros(len(part), np.uint64))
                total += part
        if sums:
            most = np.uint64(2**32 - 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(v, most).astype(np.uint32).tobytes(), 1) for v in sums.values()], pa.binary())], names=["slot", "counts"])

    rows = first.where("slot is not null").select("slot", "counts").repartition(COUNTER_ROWS, "slot").mapInArrow(tidy(add), "slot int, counts binary").collect()
    size = COUNTERS // COUNTER_ROWS
    out = np.zeros(COUNTERS, np.uint32)
    for row in rows:
        out[row["slot"] * size : (row["slot"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return Ranks(out)


def _tie(active: DataFrame, verify: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(doc_id, label): documents tied to leaders by verified links, in rounds until few leaders can be tied."""

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Pairs of a document and its leader that fit in size and whose sketches don't part them."""
        n, m = batch.column("n").to_numpy(), batch.column("y_n").to_numpy()
        marks = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in ("sketch", "y_sketch")]
        fits = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (apart(*marks) <= n + m - 2 * (-(-num * (n + m) // (num + den))))
        return batch.select(["x", "y"]).filter(pa.array(fits, pa.bool_()))

    labels = materialise(active.select("doc_id", F.col("doc_id").alias("label")).distinct(), "jaccard-labels")
    left = labels.count()
    for r in range(LEADER_ROUNDS):
        marked = active.select("doc_id", "n", "rare", "sketch", F.col("marks")[r].alias("mark"))
        if r:
            marked = marked.join(labels.where("doc_id = label").select("doc_id"), "doc_id", "left_semi")
        marked = materialise(marked, "jaccard-marked")
        leaders = marked.groupBy("mark").agg(F.min(F.struct("rare", "doc_id", "n", "sketch")).alias("lead"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        leaders = materialise(leaders.select("mark", F.col("lead.doc_id").alias("y"), F.col("lead.n").alias("y_n"), F.col("lead.sketch").alias("y_sketch")), "jaccard-leaders")
        met = spread_join(marked.withColumnRenamed("doc_id", "x"), leaders, "mark").where("x <> y").select("x", "y", "n", "y_n", "sketch", "y_sketch")
        pairs = arrow_map(met, alike, "x long, y long").distinct()
        pairs = materialise(pairs.join(leaders.select(F.col("y").alias("x")), "x", "left_anti"), "jaccard-pairs")  # ids of several texts lead or follow, not both
        tied = verify(pairs).groupBy("x").agg(F.min("y").alias("to"))
        labels = materialise(spread_join(labels, tied.withColumnRenamed("x", "label"), "label", how="left").select("doc_id", F.coalesce("to", "label").alias("label")), "jaccard-labels")
        now = labels.where("doc_id = label").count()
        if left - now <= LEAST_TIED * left:
            break
        left = now
    return labels


def _cross_candidates(active: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """(x, label, other, y): pairs under different leaders that share as many short lists as their sizes ask for."""
    words = SKETCH_BITS // 64

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = _arrays(batch.column("tokens"), np.int64)
        counts = [len(t) for t in tokens]
        repeat = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(), counts))
        listed = np.concatenate([np.arange(c) < lead for c, lead in zip(counts, batch.column("lead").to_pylist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), repeat("doc_id"), repeat("n"), repeat("label"), pa.array(listed, pa.bool_()), batch.column("sketch").take(pa.array(np.repeat(np.arange(len(counts)), counts)))], names=["token", "doc_id", "n", "label", "listed", "sketch"])

    postings = arrow_map(active.select("doc_id", "n", "tokens", "lead", "sketch").join(labels, "doc_id"), explode, "token long, doc_id long, n long, label long, listed boolean, sketch binary")
    postings = materialise(postings, "jaccard-postings")
    shares = postings.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.count_if("listed").alias("held"))
    mixed = shares.groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("c"), F.sum("held").alias("held")).where("labels > 1 and held > 0")
    mixed = materialise(mixed.select("token", F.col("most.label").alias("top"), "c", F.col("most.c").alias("top_c")), "jaccard-mixed")
    own = spread_join(postings, mixed, "token")
    part = lambda size, count: F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(count) / size)).cast("int")
    own = materialise(own.withColumn("asked", F.col("c") - F.col("top_c")), "jaccard-lists")
    item = F.struct("doc_id", "n", "label", "listed", "sketch")
    lists = own.groupBy("token", part(LIST_CHUNK, "c").alias("chunk")).agg(F.collect_list(item).alias("held"))
    asking = own.where("label <> top").groupBy("token", "top", part(QUERY_BLOCK, "asked").alias("block")).agg(F.collect_list(item).alias("asked"))
    met = asking.join(lists, "token").select("token", "top", "chunk", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("asked", "held") for c in ("doc_id", "n", "label", "listed", "sketch")))

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The pairs of a block and a chunk that may link: the larger set, the smaller one and the shingle."""
        sides = []
        for side in ("asked", "held"):
            columns = {c: batch.column(f"{side}_{c}") for c in ("doc_id", "n", "label", "listed", "sketch")}
            cuts = columns["doc_id"].offsets.to_numpy().astype(np.int64)
            flat = {c: v.values.to_numpy(zero_copy_only=False) for c, v in columns.items() if c != "sketch"}
            packed = columns["sketch"].values.cast(pa.binary(SKETCH_BITS // 8))
            flat["sketch"] = np.frombuffer(packed.buffers()[1], np.uint64).reshape(-1, words)[packed.offset : packed.offset + len(packed)]
            sides.append((cuts[:-1], np.diff(cuts), flat))
        (q_at, q_len, q), (l_at, l_len, held) = sides
        tokens, tops = batch.column("token").to_numpy(), batch.column("top").to_numpy()
        ends = np.cumsum(q_len * l_len)
        out = []
        for start in range(0, int(ends[-1]), PAIRS_AT_ONCE):
            pair = np.arange(start, min(start + PAIRS_AT_ONCE, int(ends[-1])))
            row = np.searchsorted(ends, pair, side="right")
            pair -= (ends - q_len * l_len)[row]
            i, j = q_at[row] + pair // l_len[row], l_at[row] + pair % l_len[row]
            n, m = q["n"][i], held["n"][j]
            larger = (n > m) | ((n == m) & (q["doc_id"][i] > held["doc_id"][j]))
            fits = (q["label"][i] != held["label"][j]) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
            fits &= np.where(larger, held["listed"][j], q["listed"][i] & (held["label"][j] == tops[row]))
            i, j, row, larger, n, m = (v[fits] for v in (i, j, row, larger, n, m))
            near = apart(q["sketch"][i], held["sketch"][j]) <= n + m - 2 * (-(-num * (n + m) // (num + den)))
            i, j, row, larger, n, m = (v[near] for v in (i, j, row, larger, n, m))
            big = lambda c: np.where(larger, q[c][i], held[c][j])  # noqa: B023, E731
            small = lambda c: np.where(larger, held[c][j], q[c][i])  # noqa: B023, E731
            out.append([big("doc_id"), big("n"), big("label"), small("doc_id"), small("n"), small("label"), tokens[row]])
        columns = [np.concatenate(v) for v in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["x", "x_n", "label", "y", "y_n", "other", "token"])

    near = arrow_map(met, narrow, "x long, x_n long, label long, y long, y_n long, other long, token long")
    near = materialise(near, "jaccard-near")

    def search(part: pa.Table) -> pa.Table:
        """Heap-merges the short lists of one set, and keeps who stands on enough of them."""
        n, lists = part["x_n"][0].as_py(), {}
        for token, *entry in zip(*(part[c].to_pylist() for c in ("token", "y", "y_n", "label", "other")), strict=True):
            lists.setdefault(token, []).append(tuple(entry))
        merged = merge_short([sorted(v) for v in lists.values()])
        merged = merged[merged[:, 4] >= least_listed(n, merged[:, 1], num, den)]
        x = pa.array([part["x"][0].as_py()] * len(merged), pa.int64())
        return pa.table({"x": x, **{c: pa.array(merged[:, i]) for c, i in (("label", 2), ("other", 3), ("y", 0))}})

    longest = near.groupBy("x").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("n")).first()["n"]
    bucket = F.pmod(F.xxhash64("y"), F.lit(-(-longest // (1 << 16)))).cast("int")
    candidates = near.groupBy("x", bucket.alias("bucket")).applyInArrow(search, "x long, label long, other long, y long").distinct()
    return materialise(candidates, "jaccard-candidates")
