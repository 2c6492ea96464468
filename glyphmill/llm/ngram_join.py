"""Near-duplicate documents by the exact Jaccard similarity of their word shingles.

The overlap counts are a sparse matrix product of the documents by shingles incidence with its transpose, of which only
what size bounds leave open is worked out:

1. One scan makes for each text its set of shingles and from that a 128-bit signature (equal sets collapse to one
   representative), eight minima under different hashes, and counts of all shingles in a compact form.
2. Representatives that share minima are compared with the smallest id among them. This ties large groups of near copies
   together in linear work; whatever it misses, the product finds.
3. Two sets similar enough overlap by at least c = ceil(t * size). If the shingles of a set are put in one global
   order, rarest first, two such sets share at least l of their first size - c + l shingles. Only these cells enter the
   product. A column joins only documents not yet known to be connected, block of rows by block of rows; overlaps are
   summed per pair, and pairs below the bound are dropped. A column that meets a large component would pair very many;
   its documents become part of that component's region instead.
4. Surviving pairs are compared set by set; in regions whole blocks of sets are multiplied, those outside the component
   against all. All links make components.

Counts steer the order alone; whatever they are, the result is exact. Sets are compared by 64-bit codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.graph import components
from glyphmill.llm.scratch import cut, drop, fresh_name

WORDS = 5
#: Similarity of linked texts, as a fraction.
SIMILARITY = (3, 4)
#: Shared cells asked for beyond the least prefix.
EXTRA = 4
MINIMA = 8
#: Shingles with an own place in the order; a bound for what is broadcast.
FREQUENT = 1 << 20
#: Bits per counting bin, and at most in all, of the map of shingles that occur twice; a bound for what is broadcast.
BIN_BITS, MOST_BITS = 19, 30
#: Rows of a column compared in one block.
BLOCK = 2048
#: Partners that a set is compared with in one task.
PARTNERS = 256
#: Representatives in a component from which columns that hold some of it are worked out as its region, and shingles in a block of a region.
LARGE, BLOCK_CELLS = 16, 1 << 17
#: Slots of the map of ids whose sets are needed, at most; a bound for what is broadcast.
MAP_SLOTS = 1 << 26
_SALTS = [np.uint64(0xD6E8FEB86659FD93 * (2 * i + 1) % (1 << 64)) for i in range(MINIMA)]
_FLUSH = 1 << 20
_FINGERPRINT = np.uint64(24)  # bits dropped from a code where shingles are counted


def _pack(x: np.ndarray) -> bytes:
    """Ascending unsigned 32-bit integers, as differences by byte plane."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _segments(values: np.ndarray, bounds: np.ndarray, op) -> np.ndarray:
    """op over each segment; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        wc.release()


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return wc.shingle_sets(*wc.word_codes(texts, wc.NOT_SPACE), WORDS)


_FIRST = "id bigint, n bigint, s1 bigint, s2 bigint, minima array<bigint>, bin int, once binary, often binary, times binary, kind int"


def _first_scan(bins: int):
    bits = np.uint64(bins.bit_length() - 1)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, times = np.unique(np.concatenate(held) >> _FINGERPRINT, return_counts=True)
        rest = np.uint64(40) - bits
        at = np.searchsorted(prints >> rest, np.arange(bins + 1, dtype=np.uint64))
        low = ((prints << np.uint64(32 - int(rest)) if int(rest) < 32 else prints) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows: dict[str, list] = {"bin": [], "once": [], "often": [], "times": []}
        for k in np.flatnonzero(np.diff(at)).tolist():
            x, t = low[at[k] : at[k + 1]], times[at[k] : at[k + 1]]
            rows["bin"].append(k)
            rows["once"].append(_pack(x[t == 1]))
            rows["often"].append(_pack(x[t > 1]))
            rows["times"].append(zstandard.compress(np.minimum(t[t > 1], 2**32 - 1).astype(np.uint32).tobytes(), 1))
        n = len(rows["bin"])
        none = [pa.nulls(n, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*none, pa.nulls(n, pa.list_(pa.int64())), pa.array(rows["bin"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in ("once", "often", "times")], pa.array(np.ones(n, np.int32))], _names)

    _names = ["id", "n", "s1", "s2", "minima", "bin", "once", "often", "times", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in _parts(batches):
            codes, bounds = _sets(part["text"])
            first, second = wc.mix(codes), wc.mix(codes ^ np.uint64(0xA0761D6478BD642F))
            minima = np.stack([_segments(wc.mix(codes ^ s), bounds, np.minimum) for s in _SALTS], 1).view(np.int64)
            sums = [_segments(x, bounds, np.add).view(np.int64) for x in (first, second)]
            n = part.num_rows
            empty = [pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3, pa.array(np.zeros(n, np.int32))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * MINIMA, MINIMA), pa.int32()), pa.array(minima.ravel()))
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(bounds)), *map(pa.array, sums), lists, *empty], _names)
            held.append(codes)
            size += len(codes)
            if size >= _FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _count_bins(bins: int, map_bits: int):
    """Totals of the counted shingles: frequent ones with the magnitude of their count, and a slice of the map of those met twice."""
    rest = 40 - (bins.bit_length() - 1)
    slice_bits = map_bits - (bins.bit_length() - 1)

    def total(k: int, rows: list[dict]) -> tuple:
        once = np.concatenate([_unpack(r["once"]) for r in rows])
        often = np.concatenate([_unpack(r["often"]) for r in rows])
        times = np.concatenate([np.frombuffer(zstandard.decompress(r["times"]), np.uint32) for r in rows])
        x = np.concatenate([once, often])
        t = np.concatenate([np.ones(len(once), np.int64), times.astype(np.int64)])
        order = np.argsort(x)
        x, t = x[order], t[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        x, t = x[first], np.add.reduceat(t, first)
        x, t = x[t > 1], t[t > 1]
        seen = np.zeros(1 << slice_bits, bool)
        seen[x >> np.uint32(32 - slice_bits)] = True
        many = t >= 4
        prints = (np.uint64(k) << np.uint64(rest)) | (x[many].astype(np.uint64) >> np.uint64(32 - rest) if rest < 32 else x[many].astype(np.uint64))
        return prints, np.log2(t[many]).astype(np.int32), np.packbits(seen, bitorder="little").tobytes()

    def emit(k: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        prints, size, seen = total(k, rows)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([zstandard.compress(seen, 1)], pa.binary())], ["bin", "print", "size", "seen"])
        n = len(prints)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(prints.view(np.int64)), pa.array(size), pa.nulls(n, pa.binary())], ["bin", "print", "size", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bin"] != now and rows:
                    yield from emit(now, rows)
                    rows = []
                now = r["bin"]
                rows.append(r)
        if rows:
            yield from emit(now, rows)

    return run


class _Order:
    """The global order of shingles: once met first, then the others by magnitude of their count; ties by code."""

    def __init__(self, seen: np.ndarray, map_bits: int, prints: np.ndarray, sizes: np.ndarray):
        self.seen, self.map_bits, self.prints, self.sizes = seen, map_bits, prints, sizes

    def classes(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> np.uint64(64 - self.map_bits)
        out = (self.seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        if len(self.prints):
            twice = np.flatnonzero(out)
            x = codes[twice] >> _FINGERPRINT
            i = np.minimum(np.searchsorted(self.prints, x), len(self.prints) - 1)
            hit = self.prints[i] == x
            out[twice[hit]] = self.sizes[i[hit]]
        return out


def least_overlap(n):
    """Shared shingles that any set linked with one of n has with it."""
    return (SIMILARITY[0] * n + SIMILARITY[1] - 1) // SIMILARITY[1]


def _global_order(counts: DataFrame, bins: int, map_bits: int) -> _Order:
    totals = cut(counts.where("kind = 1").select("bin", "once", "often", "times").repartition("bin").sortWithinPartitions("bin").mapInArrow(_count_bins(bins, map_bits), "bin int, print bigint, size int, seen binary"), "shingle-totals")
    per_size = {r["size"]: r["n"] for r in totals.where("print is not null").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = 64, 0
    while least > 2 and held + per_size.get(least - 1, 0) <= FREQUENT:
        least -= 1
        held += per_size.get(least, 0)
    own = totals.where(f"print is not null and size >= {least}").select("print", "size").toArrow()
    prints, sizes = own["print"].to_numpy().view(np.uint64), own["size"].to_numpy().astype(np.uint8)
    order = np.argsort(prints)
    seen = np.zeros((1 << map_bits) // 8, np.uint8)
    width = len(seen) // bins
    for r in totals.where("print is null").select("bin", "seen").toLocalIterator():
        seen[r["bin"] * width : (r["bin"] + 1) * width] = np.frombuffer(zstandard.decompress(bytes(r["seen"])), np.uint8)
    drop(totals)
    return _Order(seen, map_bits, prints[order], sizes[order])


def _prefix_scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: _Order = shared.value
        for part in _parts(batches):
            codes, bounds = _sets(part["text"])
            classes = order.classes(codes)
            sizes = np.diff(bounds)
            take = np.minimum(sizes, sizes - least_overlap(sizes) + np.minimum(EXTRA, least_overlap(sizes)))
            single = _segments((classes == 0).astype(np.int64), bounds, np.add)
            ids, cells = [], []
            for d in np.flatnonzero(single < take).tolist():
                a, b = bounds[d], bounds[d + 1]
                own = codes[a:b][np.argsort(classes[a:b], kind="stable")]
                ids.append(d)
                cells.append(own[single[d] : take[d]])  # no other set has what comes before
            if ids:
                starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(ids)), pa.array(sizes[ids]), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(cells).view(np.int64)))], ["id", "n", "cells"])

    return run


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside blocks of columns: rows sorted by (cell, i, j), with id, n, component and which side of the block they are on."""

    def pairs(x: dict) -> pa.RecordBatch | None:
        a = np.flatnonzero(x["side"] <= 0)
        b = np.flatnonzero(x["side"] >= 0)
        found = []
        ida, idb, na, nb, ca, cb = x["id"][a], x["id"][b], x["n"][a], x["n"][b], x["component"][a], x["component"][b]
        within = x["side"][0] == 0
        for s in range(0, len(a), 256):
            t = slice(s, s + 256)
            ok = (ca[t, None] != cb[None]) & (SIMILARITY[1] * na[t, None] >= SIMILARITY[0] * nb[None]) & (SIMILARITY[1] * nb[None] >= SIMILARITY[0] * na[t, None])
            if within:
                ok &= ida[t, None] < idb[None]
            i, j = np.nonzero(ok)
            i += s
            found.append(np.stack([ida[i], idb[j], na[i], nb[j]], 1))
        got = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        if not len(got):
            return None
        swap = got[:, 0] > got[:, 1]
        got[swap] = got[swap][:, [1, 0, 3, 2]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(4)], ["a", "b", "na", "nb"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "id", "n", "component", "side")}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
        edge = np.flatnonzero((np.diff(held["cell"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
        for s, e in zip([0, *edge[:-1].tolist()], edge.tolist()):
            if e - s > 1 and (out := pairs({c: v[s:e] for c, v in held.items()})) is not None:
                yield out
        if len(edge):
            held = {c: v[edge[-1] :] for c, v in held.items()}
    if held is not None and len(held["id"]) > 1 and (out := pairs(held)) is not None:
        yield out


def _id_map(ids: DataFrame):
    """A broadcast map of hashed ids (k): one bit for each of MAP_SLOTS at most, so its size is bounded whatever their number."""
    count = ids.count()
    slots = min(MAP_SLOTS, max(1 << 12, 1 << (8 * max(count, 1)).bit_length()))
    slot = F.pmod(F.xxhash64("k"), F.lit(slots))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(slots // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(table), slots


def _set_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in _parts(batches):
            slot = part["slot"].to_numpy()
            part = part.filter(pa.array((table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            if not part.num_rows:
                continue
            codes, bounds = _sets(part["text"])
            data = pa.py_buffer(codes.tobytes())
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).tobytes()), data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part["id"], blobs], ["id", "codes"])

    return run


def sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, codes) of the texts (id, text) whose id is among ids (k). Texts are filtered by a map of the ids where they lie, and aren't shuffled."""
    table, slots = _id_map(ids)
    slotted = texts.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot"))
    return cut(slotted.mapInArrow(_set_rows(table), "id bigint, codes binary"), "sets")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b with null first): sets of a, then the sets to compare with them."""
    now, left = None, []
    for batch in batches:
        out_a, out_b = [], []
        for a, salt, b, data in zip(batch["a"].to_pylist(), batch["salt"].to_pylist(), batch["b"].to_pylist(), batch["codes"]):
            own = np.frombuffer(data.as_buffer(), np.uint64)
            if (a, salt) != now:
                now, left = (a, salt), []
            if b is None:
                left.append(own.copy())
                continue
            for x in left:
                small, large = (x, own) if len(x) <= len(own) else (own, x)
                if SIMILARITY[1] * len(small) < SIMILARITY[0] * len(large) or not len(small):
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if SIMILARITY[1] * both >= SIMILARITY[0] * (len(small) + len(large) - both):
                    out_a.append(a)
                    out_b.append(b)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each set of left with each of right: the product of their incidence matrices, shingle by shingle."""
    side = []
    for sets in (left, right):
        codes = np.concatenate(sets)
        order = np.argsort(codes)
        side.append((codes[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]))
    (c0, d0), (c1, d1) = side
    common = np.intersect1d(c0, c1)
    at0, at1 = np.searchsorted(c0, common), np.searchsorted(c1, common)
    k0, k1 = np.searchsorted(c0, common, "right") - at0, np.searchsorted(c1, common, "right") - at1
    out = np.zeros(len(left) * len(right), np.int64)
    upto = np.concatenate([[0], np.cumsum(k0 * k1)])
    s = 0
    while s < len(common):
        e = max(s + 1, int(np.searchsorted(upto, upto[s] + (1 << 21), "right")) - 1)
        g = np.repeat(np.arange(s, e), (k0 * k1)[s:e])
        t = np.arange(upto[s], upto[e]) - upto[g]
        out += np.bincount(d0[at0[g] + t // k1[g]] * len(right) + d1[at1[g] + t % k1[g]], minlength=len(out))
        s = e
    return out.reshape(len(left), len(right))


def _region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (region, i, j): sets of side 0 against those of side 1. For each set of side 0 a link to every other component it has one with."""

    def links(rows: dict) -> pa.RecordBatch:
        own, other = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
        out_a, out_b = [], []
        if len(own) and len(other):
            sets = [np.frombuffer(x, np.uint64) for x in rows["codes"]]
            right = [sets[i] for i in other]
            n1, c1, i1 = np.array([len(x) for x in right]), rows["component"][other], rows["id"][other]
            for s in range(0, len(own), 512):
                some = own[s : s + 512]
                left = [sets[i] for i in some]
                n0 = np.array([len(x) for x in left])
                both = _overlaps(left, right)
                linked = (SIMILARITY[1] * both >= SIMILARITY[0] * (n0[:, None] + n1 - both)) & (rows["component"][some][:, None] != c1)
                i, j = np.nonzero(linked)
                _, first = np.unique(np.stack([i, c1[j]], 1), axis=0, return_index=True)
                out_a.append(rows["id"][some][i[first]])
                out_b.append(i1[j[first]])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([join(out_a), join(out_b)], ["a", "b"])

    held = None
    for batch in batches:
        now = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("region", "i", "j", "side", "id", "component", "codes")}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
        edge = np.flatnonzero((np.diff(held["region"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
        for s, e in zip([0, *edge[:-1].tolist()], edge.tolist()):
            yield links({c: v[s:e] for c, v in held.items()})
        if len(edge):
            held = {c: v[edge[-1] :] for c, v in held.items()}
    if held is not None and len(held["id"]):
        yield links(held)


def _region_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Links inside regions. members: (region, id, n, component), where region is a large component.

    A region's own documents hang together already; so the others are compared with all, block by block.
    """
    others = "component <> region"
    totals = members.groupBy("region").agg(F.sum(F.when(F.expr(others), F.col("n")).otherwise(0)).alias("no"), F.sum("n").alias("na"))
    blocks = totals.select(F.col("region").alias("r"), F.ceil(F.col("no") / BLOCK_CELLS).alias("rows"), F.ceil(F.col("na") / BLOCK_CELLS).alias("cols"))
    dealt = members.join(blocks, F.col("region") == F.col("r"))
    zero, part = F.lit(0).cast("bigint"), F.xxhash64(F.lit(6), "id")
    left = dealt.where(others).select("region", F.pmod(part, "rows").alias("i"), F.explode(F.sequence(zero, F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"), "id", "component")
    right = dealt.where("rows > 0").select("region", F.explode(F.sequence(zero, F.col("rows") - 1)).alias("i"), F.pmod(part, "cols").alias("j"), F.lit(1).alias("side"), "id", "component")
    sets = sets_of(texts, members.select(F.col("id").alias("k")).distinct())
    rows = left.union(right).join(sets.withColumnRenamed("id", "k"), F.col("id") == F.col("k")).drop("k")
    found = cut(rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(_region, "a bigint, b bigint").distinct(), "links")
    drop(sets)
    return found


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. texts: (id, text).

    The set of a travels once for every PARTNERS of its partners, so an id in very many pairs is dealt over many tasks.
    """
    sets = sets_of(texts, pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    right = salted.join(sets, F.col("b") == F.col("id")).select("a", "salt", "b", "codes")
    left = salts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).join(sets, F.col("a") == F.col("id"))
    rows = left.select("a", "salt", F.lit(None).cast("bigint").alias("b"), "codes").union(right)
    linked = cut(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_compare, "a bigint, b bigint").distinct(), "links")
    drop(sets)
    return linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for every row of docs; ids are integers.

    Texts are lower-cased in A-Z and split at space and tab to carriage return. Two documents link when the Jaccard
    similarity of their sets of WORDS-word shingles is SIMILARITY or more; component is the smallest id reachable. A
    text of fewer words is one shingle; one without words, null or empty, links with nothing and is its own component.
    Rows that share an id are one document that has the links of each of them. Rows with a null id link with nothing
    and have a null component. No documents give no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    bins = 1 << min(16, max(8, math.ceil(math.log2(4 * max(1, docs.rdd.getNumPartitions())))))
    map_bits = min(MOST_BITS, BIN_BITS + bins.bit_length() - 1)
    first = cut(texts.mapInArrow(_first_scan(bins), _FIRST), "shingles")
    nodes = first.where("kind = 0").select("id", "n", "s1", "s2", "minima")
    usable = nodes.where("n > 0 and id is not null")
    reps = cut(usable.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.any_value("minima").alias("minima")), "representatives")

    spread = reps.select(F.col("rep").alias("id"), "n", F.posexplode("minima").alias("h", "low"))
    heads = spread.groupBy("h", "low").agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    near = spread.join(heads.select(F.col("h").alias("h2"), F.col("low").alias("low2"), "head"), (F.col("h") == F.col("h2")) & (F.col("low") == F.col("low2")))
    t, u = SIMILARITY
    near = near.where(f"id <> head.id and {u} * n >= {t} * head.n and {u} * head.n >= {t} * n")
    stars = cut(near.groupBy(F.col("head.id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where("shared > 1").select("a", "b"), "stars")
    tied = verify(texts, stars)
    known = cut(components(tied), "tied")

    order = texts.sparkSession.sparkContext.broadcast(_global_order(first, bins, map_bits))
    labels = reps.select("rep").distinct().join(known, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    held = known.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("held"))
    labels = labels.join(held, F.col("component") == F.col("c"), "left").select("rep", "component", F.coalesce("held", F.lit(1)).alias("held"))
    prefixes = texts.where("id is not null").mapInArrow(_prefix_scan(order), "id bigint, n bigint, cells array<bigint>")
    cells = cut(prefixes.join(labels, F.col("id") == F.col("rep")).select("id", "n", "component", "held", F.explode("cells").alias("cell")).distinct(), "cells")
    columns = cells.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.max(F.struct("held", "component")).alias("top")).where("lo < hi")
    columns = cut(columns.select(F.col("cell").alias("k"), "size", F.when(F.col("top.held") >= LARGE, F.col("top.component")).alias("region")), "columns")
    regions = cells.join(columns.where("region is not null").select("k", "region"), F.col("cell") == F.col("k")).select("region", "id", "n", "component").distinct()
    in_regions = _region_links(texts, cut(regions, "regions"))
    columns = columns.where("region is null").select("k", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    mixed = cells.join(columns, F.col("cell") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = mixed.select("cell", "id", "n", "component", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "component", F.sign(F.col("own") - F.col("other")).cast("int").alias("side"))
    found = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_cross, "a bigint, b bigint, na bigint, nb bigint")
    bound = F.least(F.lit(EXTRA), F.ceil(F.lit(t) * (F.col("na") + F.col("nb")) / (t + u)))
    open_pairs = cut(found.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= bound).select("a", "b").distinct(), "pairs")
    more = verify(texts, open_pairs)

    # rows of one id with different texts hang together by the id
    split = usable.join(reps.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    again = split.join(reps.select(F.col("rep").alias("k")), F.col("b") == F.col("k"), "left_semi")
    final = components(tied.union(in_regions).union(more).union(again))
    keyed = nodes.join(reps.select(F.col("n").alias("n2"), F.col("s1").alias("r1"), F.col("s2").alias("r2"), "rep"), (F.col("n") == F.col("n2")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")), "left")
    keyed = keyed.withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    out = keyed.join(final, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    drop(stars, cells, open_pairs)
    return out.toDF(id_col, "n_shingles", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col)
    name = fresh_name(docs, "_other")
    others = cut(found.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias(name)).distinct(), "others")
    return docs.join(others, F.col(id_col) == F.col(name), "left_anti")


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("component", "component_id")


OP3_SQL = r"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w
  from documents),
sets as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') s
  from words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
sizes as (select doc_id, count(*) n from sets group by doc_id),
shared as (
  select a.doc_id x, b.doc_id y, count(*) c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
reach as (
  select doc_id x, doc_id y from documents
  union
  select reach.x, links.y from reach join links on links.x = reach.y)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id
from documents left join sizes using (doc_id) join (select x doc_id, min(y) component_id from reach group by x) using (doc_id)
"""
