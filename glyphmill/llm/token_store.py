"""Token ids in a content-addressed store.

Every text becomes a stream of ids with an end id. A rolling hash over the ids cuts streams where their content says
so; a chunk is named by the digest of its bytes and stored once, however many documents hold it. A document is a
recipe: the digests of its chunks, in order, under the root of their Merkle tree. Recipes lie in shards in ascending
order of id; a shard's manifest has the Merkle root over its documents, and the store's has the root over its shards
and where each begins in the stream of all ids. Reading checks digests and roots from the chunks upwards.

Files (Parquet) under the store's path:
  chunks/                 digest, n, payload: n ids as little-endian unsigned integers of len(payload) / n bytes
  index/kind=document/    shard, id, local_start, n_tokens, digests, lengths, root; part k is shard k
  index/kind=shard/       shard, n_tokens, n_docs, root
  ids/                    no rows: the type of ids
  manifest/               shard, start, n_tokens, n_docs, root; the last row, without a shard, is the whole store
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.scratch import cut, drop, new_path, small_batches

END_ID = 2
#: Ids in a chunk: least, one boundary in so many positions, most.
LEAST, EVERY, MOST = 128, 512, 4096
#: Ids that the rolling hash sees.
REACH = 8
#: Recipes in a shard, about.
SHARD_DOCS = 1 << 14
#: Different pieces of text whose ids a worker remembers, in about 50 bytes each.
KNOWN = 1 << 20

_BLANKS = b" \t\n\x0b\x0c\r"
#: Of each byte: 1 white space, 2 letter, 3 punctuation, 4 perhaps the first of rarer white space, 0 other.
_KINDS = np.zeros(256, np.int8)
_KINDS[33:127] = 3
_KINDS[48:58] = 0
_KINDS[65:91] = _KINDS[97:123] = 2
_KINDS[list(_BLANKS)] = 1
_KINDS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = 4


def _byte_signs() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, then from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + rest.index(b) for b in rest}


_SIGNS = {b: c for b, c in _byte_signs().items() if b != 10}  # line breaks part pieces


def cuts_like_bytes(tokenizer) -> bool:
    """Whether a tokenizer is a byte-level BPE that cuts, merges and returns ids as Encoder takes it to."""
    own = json.loads(tokenizer.to_str())
    cuts, model = own["pre_tokenizer"] or {}, own["model"]
    as_is = own["normalizer"] is None and own["truncation"] is None and own["padding"] is None
    as_is &= cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts["add_prefix_space"]
    as_is &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    signs = set(map(chr, _byte_signs().values())) | {chr(b) for b in range(256) if b not in _byte_signs()}
    as_is &= signs <= model["vocab"].keys()
    return bool(as_is and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in own["added_tokens"]))


class Encoder:
    """Whole texts to ids, with the tokenizers library for each different piece of text.

    A byte-level BPE cuts text before it merges: always between something else and white space that follows, and
    between a letter and punctuation that follows. Text is cut there (in ASCII) and each different piece is encoded
    once. Pieces of letters alone, with a space before them or not, are one word to the tokenizer's cuts, so they go
    to its model at once; other pieces that begin with white space are encoded many at a time, and come apart again by
    the lengths of their tokens in bytes. Texts with other white space, which may join across these cuts, and such that
    hold the string of an added token go to the tokenizer whole; so do all texts if the file's tokenizer is another
    kind, or cuts, pads or normalises in other ways.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.in_pieces = cuts_like_bytes(self.tokenizer)
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(token)  # a character of this vocabulary stands for a byte
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # codes of pieces in order, and the slot of each
        self.n, self.used = 0, 0
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _ids(self, pieces: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of pieces that can stand side by side, and how many each has."""
        groups = [pieces[i : i + 512] for i in range(0, len(pieces), 512)]
        out, counts = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            want = np.cumsum([len(x) for x in group])
            at = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
            if not np.array_equal(ends[at], want):  # a token across a cut
                each = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([x.decode() for x in group], add_special_tokens=False)]
                ids, at = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            out.append(ids)
            counts += np.diff(at, prepend=-1).tolist()
        return out, counts

    def _words(self, pieces: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of pieces of letters alone."""
        ids, counts, split = [], [], self.model.tokenize
        for word in b"\n".join(pieces).decode("latin-1").translate(_SIGNS).split("\n"):
            own = [t.id for t in split(word)]
            ids += own
            counts.append(len(own))
        return [np.array(ids, np.uint32)], counts

    def _learn(self, pieces: list[bytes], letters: list[bool]) -> np.ndarray:
        """Slots of pieces, after their ids have been found."""
        words = [i for i, x in enumerate(letters) if x]
        rest = [i for i, x in enumerate(letters) if not x]
        apart = [i for i in rest if pieces[i][0] not in _BLANKS or pieces[i][-1] in _BLANKS]
        alone = set(apart)
        together = [i for i in rest if i not in alone]
        found = [self._words([pieces[i] for i in words]) if words else ([], []), self._ids([pieces[i] for i in together])]
        each = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([pieces[i].decode() for i in apart], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found[0][0], *found[1][0], *each])
        counts = np.array([*found[0][1], *found[1][1], *[len(x) for x in each]], np.int64)
        n, k = self.n, len(counts)
        self.starts, self.lengths = self._room(self.starts, n + k), self._room(self.lengths, n + k)
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + k] = self.used + np.cumsum(counts) - counts
        self.lengths[n : n + k] = counts
        self.used, self.n = self.used + len(ids), n + k
        slots = np.empty(k, np.int64)
        slots[np.array(words + together + apart, np.int64)] = np.arange(n, n + k)
        return slots

    def _whole(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        parts = [np.array([*x.ids, end_id], np.uint32) for x in found]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *[len(x) for x in parts]])

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    @staticmethod
    def _odd(data: np.ndarray, kind: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts with white space or separators beyond ASCII's usual ones."""
        at = np.flatnonzero(kind == 4)  # the bytes that such begin with
        first = data[at]
        second, third = data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        odd = first < 0x20
        odd |= (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
        odd |= (first == 0xE1) & ((second == 0x9A) | (second == 0xA0))
        odd |= (first == 0xE2) & ((second == 0x81) | (second == 0x80) & ((third <= 0x8B) | (third >= 0xA8) & (third <= 0xAF)))
        odd |= (first == 0xE3) & (second == 0x80)
        return np.unique(np.searchsorted(off, at[odd], "right") - 1)

    @staticmethod
    def _letters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which pieces are ASCII and Latin-1 letters alone, with one space before them or not."""
        lead = data == 0xC3
        letter = (_KINDS[data] == 2) | lead
        letter[1:] |= lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)  # not the signs of times and division
        other = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
        begin = begin + (data[begin] == 0x20)
        return (other[begin] == other[end]) & (begin < end)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and the offsets of each."""
        if not self.in_pieces:
            return self._whole(texts, end_id)
        data, off = wc.text_bytes(texts)
        n_docs = len(off) - 1
        kind = _KINDS[data]
        first = np.zeros(len(data), bool)
        if len(data):
            first[1:] = (kind[1:] == 1) & (kind[:-1] != 1) | (kind[1:] == 3) & (kind[:-1] == 2)
            begins = off[:-1][np.diff(off) > 0]
            first[begins] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        codes = wc.span_codes(data, starts, ends)
        inverse, unique = pd.factorize(codes)
        where = np.empty(len(unique), np.int64)
        where[inverse[::-1]] = np.arange(len(codes) - 1, -1, -1)
        n_known, used = self.n, self.used
        at = np.searchsorted(self.known, unique)
        there = at < n_known
        there[there] = self.known[at[there]] == unique[there]
        slot = np.empty(len(unique), np.int64)
        slot[there] = self.slots[at[there]]
        fresh = np.flatnonzero(~there)
        raw, begin, end = data.tobytes(), starts[where[fresh]], ends[where[fresh]]
        letters = self._letters(data, begin, end)
        for s in range(0, len(fresh), 1 << 16):
            t = s + (1 << 16)
            slot[fresh[s:t]] = self._learn([raw[a:b] for a, b in zip(begin[s:t].tolist(), end[s:t].tolist())], letters[s:t].tolist())
        flat, begin, length = self.flat, self.starts[slot][inverse], self.lengths[slot][inverse]
        if self.n > KNOWN:  # what came first is the more frequent: that stays
            self.n, self.used = n_known, used
        elif len(fresh):
            new = fresh[np.argsort(unique[fresh])]
            self.known, self.slots = np.insert(self.known, at[new], unique[new]), np.insert(self.slots, at[new], slot[new])
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])] if upto[-1] else np.zeros(0, np.uint32)
        bounds = upto[np.searchsorted(starts, off)]
        odd = self._odd(data, kind, off)
        for token in self.added:
            odd = np.union1d(odd, np.flatnonzero(pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)))
        if len(odd):
            parts, sizes = [], np.diff(bounds)
            whole = set(odd.tolist())
            for d in range(n_docs):
                own = ids[bounds[d] : bounds[d + 1]]
                if d in whole:
                    own = np.array(self.tokenizer.encode(raw[off[d] : off[d + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                    sizes[d] = len(own)
                parts.append(own)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        sizes = np.diff(bounds)
        out = np.empty(len(ids) + n_docs, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n_docs), sizes)] = ids
        out[bounds[1:] + np.arange(n_docs)] = end_id
        return out, bounds + np.arange(n_docs + 1)


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end, and for each text where its chunks begin in that list. Every text has one chunk at least."""
    h = wc.mix(ids.astype(np.uint64) + np.uint64(1))
    reach = 1
    while reach < min(REACH, len(ids)):  # h of 2 r ids from two of r
        longer = h * np.uint64(pow(0x9E3779B97F4A7C15, reach, 1 << 64))
        longer[reach:] += h[:-reach]
        h, reach = longer, 2 * reach
    marks = np.flatnonzero((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) < np.uint64((1 << 24) // EVERY)) + 1
    first = np.searchsorted(marks, bounds[:-1], "right").tolist()
    marks = marks.tolist()
    ends, at = [], [0]
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        k = first[d]
        while b - a > LEAST:
            while k < len(marks) and marks[k] < a + LEAST:
                k += 1
            e = min(marks[k] if k < len(marks) else b, a + MOST, b)
            ends.append(e)
            a = e
        if a < b:
            ends.append(b)
        at.append(len(ends))
    return np.array(ends, np.int64), np.array(at)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over leaves of 16 bytes; an odd one out rises as it is; no leaves: zeros."""
    level = leaves or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class _Growing:
    """Merkle root of leaves that come one by one, in memory of the tree's height."""

    def __init__(self):
        self.full: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for k in range(len(self.full)):
            if self.full[k] is None:
                self.full[k] = leaf
                return
            leaf, self.full[k] = hashlib.blake2b(self.full[k] + leaf, digest_size=16).digest(), None
        self.full.append(leaf)

    def root(self) -> bytes:
        out = None
        for x in self.full:
            if x is not None:
                out = x if out is None else hashlib.blake2b(x + out, digest_size=16).digest()
        return out or bytes(16)


_encoders: dict[str, Encoder] = {}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)  # what it has learned serves the worker's next tasks
        encoder, seen = _encoders[path], set()
        for batch in batches:
            for cut_at in range(0, batch.num_rows, 1024):
                part = batch.slice(cut_at, 1024)
                ids, bounds = encoder.encode(part["text"], end_id)
                ends, at = chunk_ends(ids, bounds)
                starts = np.concatenate([[0], ends[:-1]])
                top = np.maximum.reduceat(ids, starts) if len(ids) else ids
                narrow, wide, digests, fresh = memoryview(ids.astype("<u2").tobytes()), memoryview(ids.astype("<u4").tobytes()), [], []
                for s, e, small in zip(starts.tolist(), ends.tolist(), (top < 1 << 16).tolist()):
                    payload = narrow[2 * s : 2 * e] if small else wide[4 * s : 4 * e]
                    digest = hashlib.blake2b(payload, digest_size=16).digest()
                    digests.append(digest)
                    if digest not in seen:
                        seen.add(digest)
                        fresh.append((digest, e - s, bytes(payload)))
                edge = at.tolist()
                roots = [merkle_root(digests[a:b]) for a, b in zip(edge[:-1], edge[1:])]
                n, lists = part.num_rows, pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(bounds)), pa.ListArray.from_arrays(lists, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(lists, pa.array((ends - starts).astype(np.int32))), pa.array(roots, pa.binary()), *[pa.nulls(n, pa.binary())] * 2, pa.nulls(n, pa.int32()), pa.array(["document"] * n)], _STAGED)
                if fresh:
                    n, (d, size, data) = len(fresh), zip(*fresh)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, part["id"].type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), pa.array(d, pa.binary()), pa.array(data, pa.binary()), pa.array(size, pa.int32()), pa.array(["chunk"] * n)], _STAGED)
            wc.release()

    return run


_STAGED = ["id", "n_tokens", "digests", "lengths", "root", "digest", "payload", "n", "kind"]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes in order get their place in the shard; at the end comes the shard's manifest."""
    shard, tree, total, docs, id_type = TaskContext.get().partitionId(), _Growing(), 0, 0, None
    for batch in batches:
        sizes = batch["n_tokens"].to_numpy()
        starts = total + np.cumsum(sizes) - sizes
        for r in batch["root"].to_pylist():
            tree.add(r)
        total, docs, id_type, n = total + int(sizes.sum()), docs + batch.num_rows, batch["id"].type, batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), batch["id"], pa.array(starts), batch["n_tokens"], batch["digests"], batch["lengths"], batch["root"], pa.nulls(n, pa.int64()), pa.array(["document"] * n)], _INDEX)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.array([total]), pa.nulls(1, pa.list_(pa.binary())), pa.nulls(1, pa.list_(pa.int32())), pa.array([tree.root()], pa.binary()), pa.array([docs]), pa.array(["shard"])], _INDEX)


_INDEX = ["shard", "id", "local_start", "n_tokens", "digests", "lengths", "root", "n_docs", "kind"]
_MANIFEST = "shard int, start bigint, n_tokens bigint, n_docs bigint, root binary"


def _index_schema(id_type: str) -> str:
    return f"shard int, id {id_type}, local_start bigint, n_tokens bigint, digests array<binary>, lengths array<int>, root binary, n_docs bigint, kind string"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode all texts of docs and write them under path.

    Null and empty texts have only the end id. Rows with equal ids are each a document, in order of their roots; null
    ids come first. Equal chunks are stored once. No documents make a store without chunks, of no shards.
    Other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    staged = cut(own.mapInArrow(_encode(tokenizer_path, end_id), f"id {id_type}, n_tokens bigint, digests array<binary>, lengths array<int>, root binary, digest binary, payload binary, n int, kind string"), "encoded", ["kind"])
    zstd = {"compression": "zstd"}
    chunks = staged.where("kind = 'chunk'").groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
    chunks.write.options(**zstd).parquet(f"{path}/chunks")
    own.select("id").limit(0).write.parquet(f"{path}/ids")
    recipes = staged.where("kind = 'document'").select("id", "n_tokens", "digests", "lengths", "root")
    shards = max(1, -(-recipes.count() // SHARD_DOCS))
    ordered = recipes.repartitionByRange(shards, F.col("id").asc_nulls_first(), "root").sortWithinPartitions(F.col("id").asc_nulls_first(), "root")
    ordered.mapInArrow(_shard, _index_schema(id_type)).write.options(**zstd).partitionBy("kind").parquet(f"{path}/index")
    drop(staged)
    shards = spark.read.schema(_index_schema(id_type)).parquet(f"{path}/index").where("kind = 'shard'").select("shard", "n_tokens", "n_docs", "root")
    # a row per shard, in order, through one task in constant memory
    shards.coalesce(1).sortWithinPartitions("shard").mapInArrow(_manifest, _MANIFEST).write.parquet(f"{path}/manifest")


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, total, docs = _Growing(), 0, 0
    for batch in batches:
        sizes = batch["n_tokens"].to_numpy()
        yield pa.RecordBatch.from_arrays([batch["shard"], pa.array(total + np.cumsum(sizes) - sizes), batch["n_tokens"], batch["n_docs"], batch["root"]], _MANIFEST_NAMES)
        total, docs = total + int(sizes.sum()), docs + pc.sum(batch["n_docs"], min_count=0).as_py()
        for r in batch["root"].to_pylist():
            tree.add(r)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([0]), pa.array([total]), pa.array([docs]), pa.array([tree.root()], pa.binary())], _MANIFEST_NAMES)


_MANIFEST_NAMES = ["shard", "start", "n_tokens", "n_docs", "root"]


def _check_manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards in order, then the whole store; each must follow from those before."""
    tree, total, docs, last, whole = _Growing(), 0, 0, -1, None
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if whole is not None or any(r[c] is None for c in _MANIFEST_NAMES[1:]):
                raise ValueError("the manifest has rows that it can't have")
            if r["shard"] is None:
                whole = r
                continue
            if r["shard"] <= last or r["start"] != total or (r["n_tokens"], r["n_docs"], r["root"]) != (r["own_tokens"], r["own_docs"], r["own_root"]):
                raise ValueError(f"shard {r['shard']} isn't what the manifest says")
            tree.add(r["root"])
            last, total, docs = r["shard"], total + r["n_tokens"], docs + r["n_docs"]
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in _MANIFEST_NAMES} for r in rows if r["shard"] is not None], pa.schema([("shard", pa.int32()), *[(c, pa.int64()) for c in _MANIFEST_NAMES[1:4]], ("root", pa.binary())]))
    if whole is None or (whole["start"], whole["n_tokens"], whole["n_docs"], whole["root"]) != (0, total, docs, tree.root()):
        raise ValueError("the shards aren't what the manifest says of the whole store")


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for digest, n, payload in zip(batch["digest"].to_pylist(), batch["n"].to_pylist(), batch["payload"].to_pylist()):
            if digest is None or n is None or payload is None or len(payload) not in (2 * n, 4 * n) or hashlib.blake2b(payload, digest_size=16).digest() != digest:
                raise ValueError(f"chunk {digest.hex() if digest else None} isn't what its digest says")
            crcs.append(zlib.crc32(payload if len(payload) == 4 * n else np.frombuffer(payload, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch["digest"], batch["n"], pa.array(crcs, pa.int64())], ["digest", "n", "crc"])


def _zero_shifts() -> np.ndarray:
    """For k = 0, 1, ...: what 2**k zero bytes make of each bit of a crc32, as a table of 32 columns."""
    def times(m: np.ndarray, v: int) -> int:
        out = 0
        for b in range(32):
            if v >> b & 1:
                out ^= int(m[b])
        return out

    m = np.array([0xEDB88320, *[1 << b for b in range(31)]], np.uint64)  # one zero bit
    tables = []
    for k in range(3 + 48):
        if k >= 3:
            tables.append(m)
        m = np.array([times(m, int(x)) for x in m], np.uint64)
    return np.array(tables)


def shift_crc(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 values moved over so many zero bytes; the crc of joined parts is the xor of theirs, each moved over what follows."""
    crc = crc.astype(np.uint64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        on = np.flatnonzero(zeros >> k & 1)
        x, out = crc[on], np.zeros(len(on), np.uint64)
        for b in range(32):
            out ^= np.where(x >> np.uint64(b) & np.uint64(1), tables[k][b], np.uint64(0))
        crc[on] = out
    return crc


def _check_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, each its row of the manifest and then its recipes by place: the references to chunks, after each shard has been made anew."""
    shard, tree, total, docs, said = None, _Growing(), 0, 0, None

    def close() -> None:
        if said is not None and (said["n_tokens"], said["n_docs"], said["root"]) != (total, docs, tree.root()):
            raise ValueError(f"shard {shard}: its recipes aren't what the manifest says")

    for batch in batches:
        heads, recipes = batch.filter(pc.less(batch["local_start"], 0)).to_pylist(), batch.filter(pc.greater_equal(batch["local_start"], 0))
        if batch.num_rows != len(heads) + recipes.num_rows or recipes["digests"].null_count or recipes["lengths"].null_count:
            raise ValueError("a recipe has no place or no chunks")
        lengths, digests = recipes["lengths"].flatten().to_numpy().astype(np.int64), recipes["digests"].flatten()
        sizes = recipes["lengths"].value_lengths().to_numpy()
        if not np.array_equal(sizes, recipes["digests"].value_lengths().to_numpy()):
            raise ValueError("a recipe has other lengths than chunks")
        at = np.concatenate([[0], np.cumsum(sizes)])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        n_tokens = recipes["n_tokens"].to_numpy()
        if not np.array_equal(n_tokens, upto[at[1:]] - upto[at[:-1]]):
            raise ValueError("a recipe's length isn't that of its chunks")
        listed, roots, starts = digests.to_pylist(), recipes["root"].to_pylist(), np.empty(recipes.num_rows, np.int64)
        d = 0
        for own, place in zip(batch["shard"].to_pylist(), batch["local_start"].to_pylist()):
            if place < 0:
                close()
                if own == shard:
                    raise ValueError(f"shard {own} is in the manifest twice")
                shard, tree, total, docs, said = own, _Growing(), 0, 0, heads.pop(0)
                continue
            if said is None or own != shard or place != total or merkle_root(listed[at[d] : at[d + 1]]) != roots[d]:
                raise ValueError(f"document {recipes['id'][d]}: its recipe isn't what its root and place say")
            tree.add(roots[d])
            starts[d] = said["start"] + place
            total, docs, d = total + int(n_tokens[d]), docs + 1, d + 1
        doc = np.repeat(np.arange(recipes.num_rows), np.diff(at))
        row, nth = pa.array(doc), np.arange(len(doc)) - at[doc]
        yield pa.RecordBatch.from_arrays([recipes["id"].take(row), pa.array(starts[doc]), recipes["n_tokens"].take(row), pa.array(nth.astype(np.int32)), digests, pa.array(lengths.astype(np.int32)), pa.array(upto[at[1:]][doc] - upto[1:])], ["id", "start", "n_tokens", "nth", "chunk", "length", "tail"])
    close()


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _zero_shifts()
    for batch in batches:
        if batch["crc"].null_count or not batch["n"].equals(batch["length"]):
            raise ValueError("a recipe names a chunk that isn't in the store")
        moved = shift_crc(batch["crc"].to_numpy(), 4 * batch["tail"].to_numpy(), tables)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["start"], batch["n_tokens"], batch["length"], pa.array(moved.astype(np.int64))], ["id", "start", "n_tokens", "length", "crc"])


def _references(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, nth, chunk, length, tail) of every chunk of every document: index and manifest made anew and compared, as they are read."""
    small_batches(spark)
    id_type = spark.read.parquet(f"{path}/ids").schema["id"].dataType.simpleString()
    index = spark.read.schema(_index_schema(id_type)).parquet(f"{path}/index")
    own = index.where("kind = 'shard'").select(F.col("shard").alias("own"), F.col("n_tokens").alias("own_tokens"), F.col("n_docs").alias("own_docs"), F.col("root").alias("own_root"))
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").join(own, F.col("shard") == F.col("own"), "left")
    manifest = manifest.coalesce(1).sortWithinPartitions(F.col("shard").asc_nulls_last()).mapInArrow(_check_manifest, _MANIFEST)
    heads = manifest.withColumn("local_start", F.lit(-1).cast("bigint"))
    recipes = index.where("kind = 'document'").drop("n_docs", "kind")
    ordered = heads.unionByName(recipes, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "local_start")
    return ordered.mapInArrow(_check_recipes, f"id {id_type}, start bigint, n_tokens bigint, nth int, chunk binary, length int, tail bigint")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, crc) of every document, from the files: its place in the stream of all ids and the crc32 of its ids.

    Each chunk is read once, and its digest checked; so are the roots of documents, shards and store, the places and
    the counts. Anything that is missing, there twice or other than said is an error. A document's crc32 follows from
    those of its chunks, so no ids are moved.
    """
    references = _references(spark, path)
    id_type = references.schema["id"].dataType.simpleString()
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").mapInArrow(_check_chunks, "digest binary, n int, crc bigint")
    joined = references.join(chunks, F.col("chunk") == F.col("digest"), "left").select("id", "start", "n_tokens", "length", "tail", "n", "crc")
    moved = joined.mapInArrow(_move, f"id {id_type}, start bigint, n_tokens bigint, length int, crc bigint")
    out = moved.groupBy("id", "start", "n_tokens").agg(F.sum("length").alias("length"), F.bit_xor("crc").alias("crc"))
    return out.select("id", "start", F.when(F.col("length") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a chunk is there twice")).cast("bigint")).alias("n_tokens"), "crc")


_CHUNKS = "digest binary, n int, payload binary"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids): the documents themselves, put together from their chunks, with the checks of verify_store()."""
    references = _references(spark, path)
    id_type = references.schema["id"].dataType.simpleString()

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in _check_chunks(iter([batch])):
                yield batch

    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").mapInArrow(checked, _CHUNKS)
    joined = references.join(chunks, F.col("chunk") == F.col("digest"), "left")
    parts = joined.groupBy("id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("nth", "length", "n", "payload"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n_tokens, row in zip(batch["n_tokens"].to_pylist(), batch["parts"].to_pylist()):
                if any(p["payload"] is None or p["n"] != p["length"] for p in row) or sum(p["n"] for p in row) != n_tokens:
                    raise ValueError("a recipe names a chunk that isn't in the store, or is there twice")
                out.append(np.concatenate([np.frombuffer(p["payload"], "<u2" if len(p["payload"]) == 2 * p["n"] else "<u4").astype(np.int64) for p in row]).tolist())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["start"], pa.array(out, pa.list_(pa.int64()))], ["id", "start", "ids"])

    return parts.mapInArrow(join, f"id {id_type}, start bigint, ids array<bigint>")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_file())
    return verify_store(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
