"""BPE encoding and decoding, exact as the tokenizers library, also for very long unsplit text.

White space always parts pretokens here, so a document is cut at white space and each distinct piece is encoded
once by the library and remembered.  A piece longer than ``leaf`` bytes goes by tree concatenation:
its pretokens are halved down to leaves, the leaves are encoded in parallel over the cluster, and
neighbours are joined pairwise.  At a join the tokens around it are re-encoded in a window
that doubles until it agrees with both sides: a seam holds if the two tokens beside it, encoded
together, come out as the same two tokens, which for BPE makes the whole sequence the encoding.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, arrow_map, give_back, materialise, small_batches

#: Longest piece, in bytes, that the library encodes at once, and the symbols of a leaf.
LEAF = 4096
#: Pieces in a generation of those whose ids a worker remembers; it keeps two, and what is met again stays.
REMEMBERED = 60_000
#: Bytes of text that are cut into pieces at once.
CUT_BYTES = 1 << 19

#: The tokenizer file's own pattern of pretokens, as it stands in the JSON text.  For pieces
#: of ASCII and accented Latin-1 letters, which NFC leaves alone and which lower-case one to one, _PRETOKEN is the same.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"""
_PLAIN = re.compile(r"(?:(?!<\|)[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])+")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class Codec:
    """A tokenizer of the tokenizers library, from the text of its JSON file."""

    def __init__(self, text: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already fills the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(text)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.strings = [""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.strings[i] = token
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._text = text
        self._ranks: dict | None = None
        self._cache: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._older_words: dict[str, bytes] = {}
        self._letters = {c: "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x100)} if self.tokenizer.pre_tokenizer else {}
        self._plain = _SPLIT in text and sys.byteorder == "little"

    # whole texts

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; no piece may be over LEAF."""
        out, start = [], 0
        while start < len(texts):
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= CUT_BYTES:
                size += len(texts[end])
                end += 1
            split = [t.split() for t in texts[start:end]]
            for w in set().union(*split):
                if w not in self._cache:
                    self._cache[w] = self._older.get(w) or self._piece(w)
            get = self._cache.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            if len(self._cache) > REMEMBERED:
                self._cache, self._older = {}, self._cache
            start = end
        return out

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece without white space."""
        text = piece.decode("utf-8", "replace")
        if not self._plain or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for word in _PRETOKEN.findall(text.lower()):
            ids = self._words.get(word) or self._older_words.get(word)
            if ids is None:
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(word.translate(self._letters))]).tobytes()
            self._words[word] = ids
            out.append(ids)
        if len(self._words) > REMEMBERED:
            self._words, self._older_words = {}, self._words
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.strings.__getitem__, numbers))

    # long pieces

    def parts(self, piece: str) -> list[str | int]:
        """The pretokens of a long piece, in the model's characters; added tokens as ids."""
        found: list[str | int] = []
        for text in self._split.split(piece) if self._split else [piece]:
            if text in self.added:
                found.append(self.added[text])
            elif text:
                found += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        return found

    def _prepare(self) -> None:
        """Ranks of pairs of ids, and each token's first symbols."""
        self._ranks, self._symbols = {}, {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.loads(self._text)["model"]["merges"]]
        joined = {a + b for a, b in merges}
        for token, i in self.ids.items():
            if token not in joined and token not in self.added:
                self._symbols[i] = (i,)
        for rank, (a, b) in enumerate(merges):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self._ranks.setdefault((x, y), (rank, z))
            self._symbols.setdefault(z, self._symbols[x] + self._symbols[y])

    def symbols(self, text: str, final: bool) -> list[int]:
        """The first symbols of a stretch of a pretoken, whose last carries the word's end if ``final``."""
        out = [self.ids.get(c, -1) for c in text]
        if final and out:
            out[-1] = self.ids.get(text[-1] + self.suffix, -1)
        return [x for x in out if x >= 0]

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain BPE: the pair of least rank first, the leftmost among equals."""
        if self._ranks is None:
            self._prepare()
        ranks, ids = self._ranks, list(symbols)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := ranks.get((new, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, new, ids[after[i]], r[1]))
            if before[i] >= 0 and (r := ranks.get((ids[before[i]], new))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], new, r[1]))
        return [x for x in ids if x is not None]

    def _again(self, tokens: list[int]) -> list[int]:
        return self.merge([s for t in tokens for s in self._symbols[t]])

    def _agree(self, a: int, b: int) -> bool:
        return self._again([a, b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts together, from the encodings of each."""
        if self._ranks is None:
            self._prepare()
        if not left or not right:
            return left + right
        w = 1
        while True:
            head, tail = left[: max(0, len(left) - w)], right[w:]
            middle = self._again(left[len(head) :] + right[:w])
            if (not head or self._agree(head[-1], middle[0])) and (not tail or self._agree(middle[-1], tail[0])):
                return head + middle + tail
            w *= 2

    def concatenate(self, leaves: list[list[int]]) -> list[int]:
        """Join neighbours pairwise until one sequence is left."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []


_codecs: dict[int, Codec] = {}


def codec(text: str) -> Codec:
    key = hash(text)
    if key not in _codecs:
        _codecs[key] = Codec(text)
        give_back()
    return _codecs[key]


def has_long(text: bytes, leaf: int) -> bool:
    return len(text) > leaf and max(map(len, text.split()), default=0) > leaf


def encode_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Encode whole texts with the tokenizer file at ``path`` (on the driver), then decode.

    Returns one row for each input row: ``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``,
    ``decoded``.  No special tokens are added; their strings in a text become their ids, as in the library.  A null or
    empty text has no ids and decodes to the empty string.  Rows that share an id stay apart.
    Extra columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:  # the driver's file; workers get its text
        file = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, ids binary, n_tokens long, decoded string"

    def finish(ids: pa.Array, codes: list[bytes], c: Codec) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.binary()), pa.array([len(x) // 4 for x in codes], pa.int64()), pa.array(map(c.decode, codes), pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = codec(file.value), as_bytes(batch.column("text"))
        keep = [not has_long(t, leaf) for t in texts]
        texts = [t for t, k in zip(texts, keep, strict=True) if k]
        place = {t: i for i, t in enumerate(dict.fromkeys(texts))}  # copies in a batch are encoded and decoded once
        once = finish(pa.nulls(len(place), batch.column("doc_id").type), c.encode(list(place)), c)
        full = once.take(pa.array([place[t] for t in texts], pa.int64()))
        return full.set_column(0, "doc_id", batch.column("doc_id").filter(pa.array(keep, pa.bool_())))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of documents with long pieces: finished ids (leaf null), or the text of a leaf."""
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if not has_long(text, leaf):
                continue
            c, key, part, waiting = codec(file.value), uuid.uuid4().bytes, 0, []

            def add(ids: bytes | None, piece: str | None, at: int | None, final: bool) -> None:
                rows.append((doc, key, part, at, final, ids, piece))

            for word in text.split():
                if len(word) <= leaf:
                    waiting.append(word)
                    continue
                add(c.encode([b" ".join(waiting)])[0], None, None, False)
                waiting, part = [], part + 1
                for piece in c.parts(word.decode("utf-8", "replace")):
                    if isinstance(piece, int):
                        add(np.array([piece], "<u4").tobytes(), None, None, False)
                    else:
                        for at in range(0, len(piece), leaf):
                            add(None, piece[at : at + leaf], at, at + leaf >= len(piece))
                    part += 1
            add(c.encode([b" ".join(waiting)])[0], None, None, False)
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [batch.column("doc_id").type, pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
        names = ["doc_id", "key", "part", "at", "final", "ids", "piece"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    leaves = materialise(arrow_map(docs, cut, f"doc_id {kind}, key binary, part long, at long, final boolean, ids binary, piece string"), "bpe-leaves")

    def encode_leaf(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(file.value)
        ids = [i if p is None else np.array(c.merge(c.symbols(p, f)), "<u4").tobytes() for i, p, f in zip(*(batch.column(x).to_pylist() for x in ("ids", "piece", "final")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(x) for x in ("doc_id", "key", "part", "at")] + [pa.array(ids, pa.binary())], names=["doc_id", "key", "part", "at", "ids"])

    spread = leaves.repartition(spark.sparkContext.defaultParallelism * 2, "key", "part", "at")
    encoded = arrow_map(spread, encode_leaf, f"doc_id {kind}, key binary, part long, at long, ids binary")

    def gather(part: pa.Table) -> pa.Table:
        c = codec(file.value)
        rows = sorted(zip(*(part[x].to_pylist() for x in ("part", "at", "ids")), strict=True), key=lambda r: (r[0], r[1] or 0))
        groups: dict[int, list[list[int]]] = {}
        for number, _, ids in rows:
            groups.setdefault(number, []).append(np.frombuffer(ids, "<u4").tolist())
        whole = np.array([i for g in groups.values() for i in c.concatenate(g)], "<u4").tobytes()
        return pa.Table.from_batches([finish(part["doc_id"].combine_chunks()[:1], [whole], c)])

    return arrow_map(docs, plain, out).unionByName(encoded.groupBy("key").applyInArrow(gather, out))
