"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, exactly.

1. A document's set is a sorted array of 64-bit hashes, named by a hash of its own; equal sets are one node from then on.
2. Shingles are put in one order for all sets: those that many sets of a task hold come last, by how often they occur, the
   others by their hash. Sets with that similarity share one of their first |s| - ceil(0.8 |s|) + 1 shingles: their tile keys.
   Any order is exact; this one keeps common passages out of the keys.
3. Keys go to ranges of hashes as packed arrays, one shuffle. A range drops the keys that one set alone has, and those whose
   place rules out every partner: a pair that first meets at place i of a set of n has at most n - i shingles in common.
   Keys that a task sees in more than CHUNK sets skip the range, so that no key fills one task. A key of SHORT sets or fewer gives
   the pairs that its places allow, each once a range: texts that share a passage share many keys, but are one pair. The sets
   of longer keys are a tile.
4. Each set is tried against the TRIES least sets that its keys lead to. What links so is joined to components. The other pairs
   of short keys are tried if their components still differ.
5. Tiles that still hold several components are cut into bands of size (only neighbouring bands can link) and blocks of
   bounded length, and pairs of different components are tried against each other: first a spanning forest of each
   tile's candidates, then, with the components this gives, every pair left of the rows that were in such a pair, once, in
   the tile of its least common key.
6. A pair is tried by its bitmaps first: the bits in which two parity bitmaps differ are no more than the elements in which
   the sets differ, so bit counts bound the overlap from above. What is left is settled by intersecting the sorted arrays.
A pair that steps 4 and 5 leave out is known to be connected, so components are exact.

Defined cases: documents without words have the empty set, size 0, and link with nothing, not even each other; a null
doc_id is no component's name unless it is alone there; repeated rows are equal sets and link; an empty table gives an empty
result; long texts have long arrays, without a cap. Different shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import discard, fresh, written
from marketlens.llm.graph import components, extended

SHINGLE = 5
BLOCK, BITS, MATRIX = 1024, 64, 1 << 18
#: Sets of a task that make a shingle common, and how many common ones are ordered by their count (the rest by hash alone).
COMMON, ORDERED = 8, 1 << 18
#: Keys for each range, keys that a task packs at once, sets of a key that go through a range from one pack.
RANGE, PACK, CHUNK = 1 << 18, 1 << 18, 256
#: Sets of a key that give pairs, at most 15.5 for each set; more are a tile, which takes a bitmap with each set.
SHORT = 32
SEEN, FILTER_BITS, TRIES = 1 << 16, 25, 4
_P = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = np.uint64((1 << 48) - 1)


class Words(dict):
    """Hashes of words; keeps 2^16 short ones at most and lives as long as its task, so a reused worker stays small."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1 << 16 and len(word) <= 32:
            self[word] = h
        return h


def shingles(text: str | None, memo: Words | None = None) -> np.ndarray:
    """The distinct 5-word shingles as sorted hashes; of fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes lower A-Z alone, and split at the same six bytes
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((Words() if memo is None else memo).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    s = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        s = s * _P + h[k : k + n]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """For each place, whether an odd number of elements falls there. Unrelated sets differ in about half the places, sets
    that link in 2/9 of |s| at most. With eight thirds of |s| places few elements fall together, so sets just below the bound
    seldom pass."""
    bits = BITS
    while 3 * bits < 8 * len(s):
        bits *= 2
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def narrowed(b: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer places: halves fold together by exclusive or, as the place is the hash's low bits."""
    while b.shape[-1] > size:
        b = b[..., : b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2 :]
    return b


def may_link(n: int | np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """overlap <= (n + m - differ) / 2, and a link needs 9 * overlap >= 4 * (n + m); so differ <= (n + m) / 9."""
    return 9 * differ <= n + m


def n_keys(n: int) -> int:
    return n - -(-4 * n // 5) + 1


class _Seen(set):
    """The sets that a task has shown; forgets all once there are SEEN, so that a set may be shown again."""

    def new(self, sid: int) -> bool:
        if sid in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(sid)
        return True


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def described(docs: DataFrame, place: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """place, key, sid, n, at, map: a row for each document, with a map where the task has not shown the set yet, and at, a
    hash of the text. Rows of token and times: shingles that COMMON sets or more of one stretch of a task hold."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["place", "key", "sid", "n", "at", "map", "token", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, held, size, schema = Words(), _Seen(), [], 0, None

        def common() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times >= COMMON].view(np.int64), times[times >= COMMON]
            none = [pa.nulls(len(token), t) for t in schema.types[:6]]
            return pa.record_batch([*none, pa.array(token), pa.array(times)], names=names)

        for rows in _slices(batches):
            sid, n, maps = [], [], []
            for x in rows.column(2).to_pylist():
                s = shingles(x, memo)
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                new = len(s) > 0 and seen.new(sid[-1])
                maps.append(bitmap(s) if new else None)
                if new:
                    held.append(s)
                    size += len(s)
            none = pa.nulls(rows.num_rows, pa.int64())
            out = pa.record_batch([rows.column(0), rows.column(1), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), rows.column(3), pa.array(maps, pa.binary()), none, none], names=names)
            schema = out.schema
            yield out
            if size > 4 * PACK:
                yield common()
                held, size = [], 0
        if held:
            yield common()

    columns = docs.select(place, key, text, F.xxhash64(text))
    return columns.mapInArrow(run, f"place long, key {kind}, sid long, n long, at long, map binary, token long, times long")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """The ORDERED most common shingles at most, rarest first."""
    top = sets.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(ORDERED)
    return top.toArrow()["token"].to_numpy()[::-1].view(np.uint64)


def _level(n: np.ndarray) -> np.ndarray:
    """Sizes on a scale of 256 steps of 5 per cent, rounded down, so that a <= b gives level a <= level b."""
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(1.05) + 1e-9, 255).astype(np.uint8)


def packed_keys(docs: DataFrame, common: np.ndarray, ranges: int, text: str = "text") -> DataFrame:
    """range, low, high (48 bits of the key), sid, size, most (the largest partner that a key's place allows), lead.

    Packed arrays, one row for each range of a pack. The range is negative, and lead known, for the sets of a key beyond the first CHUNK.
    """
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order.astype(np.int32) + 1))

    def ordered(s: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            hit = keys[at] == s
            if hit.any():
                return s[np.argsort(np.where(hit, rank[at], 0), kind="stable")[: n_keys(len(s))]]
        return s[: n_keys(len(s))]

    def pack(token: list[np.ndarray], sid: list[int], size: list[int]) -> pa.RecordBatch:
        counts = np.array([len(t) for t in token])
        n = np.repeat(np.array(size, float), counts)
        places = np.concatenate([np.arange(k) for k in counts])
        t, ids = np.concatenate(token) & _TOKEN, np.repeat(np.array(sid, np.int64), counts)
        o = np.lexsort((ids, t))
        o = o[np.append(True, (t[o][1:] != t[o][:-1]) | (ids[o][1:] != ids[o][:-1]))]
        t, ids, size_, most = t[o], ids[o], _level(n)[o], _level(np.floor(1.25 * n - 2.25 * places + 1e-6))[o]
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        runs = np.diff(np.append(starts, len(t)))
        over = np.arange(len(t)) - np.repeat(starts, runs) > CHUNK  # CHUNK + 1 go through the range, which then drops none of them
        lead = np.repeat(ids[starts], runs)
        where = (t % np.uint64(ranges)).astype(np.int64)
        where[over] = -1 - np.arange(len(t))[over] // CHUNK % ranges
        o = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.append(True, where[o][1:] != where[o][:-1]))
        parts = [(t & np.uint64(0xFFFFFFFF)).astype("<u4"), (t >> np.uint64(32)).astype("<u2"), ids, size_, most]
        cols = [[x.tobytes() for x in np.split(p[o], cuts[1:])] for p in parts]
        leads = [x.tobytes() if r < 0 else None for r, x in zip(where[o][cuts].tolist(), np.split(lead[o], cuts[1:]))]
        return pa.record_batch([pa.array(where[o][cuts]), *(pa.array(c, pa.binary()) for c in (*cols, leads))], names=["range", "low", "high", "sid", "size", "most", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = shared.value
        memo, seen, token, sid, size, held = Words(), _Seen(), [], [], [], 0
        for rows in _slices(batches):
            for x in rows.column(0).to_pylist():
                s = shingles(x, memo)
                if len(s) and seen.new(name := set_id(s)):
                    token.append(ordered(s, keys, rank))
                    sid.append(name)
                    size.append(len(s))
                    held += len(token[-1])
            if held >= PACK:
                yield pack(token, sid, size)
                token, sid, size, held = [], [], [], 0
        if token:
            yield pack(token, sid, size)

    return docs.select(text).mapInArrow(run, "range long, low binary, high binary, sid binary, size binary, most binary, lead binary")


def _partners(starts: np.ndarray, counts: np.ndarray, size: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run (starts, counts) whose sizes both places allow, by their distance in the run."""
    for d in range(1, int(counts.max(initial=0))):
        mine = counts > d
        n = counts[mine] - d
        i = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ok = i[(size[i + d] <= most[i]) & (size[i] <= most[i + d])]
        yield ok, ok + d


def _partnered(starts: np.ndarray, counts: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of runs (starts, counts) have a partner in their run whose size both places allow; runs over CHUNK are kept whole,
    and those up to SHORT left out."""
    keep = np.repeat(counts > CHUNK, counts)
    mine = (counts > SHORT) & (counts <= CHUNK)
    for i, j in _partners(starts[mine], counts[mine], size, most):
        keep[i] = keep[j] = True
    return keep


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs in the order of their ranges -> token, sid, lead of the keys that more than SHORT sets have; for the others' pairs,
    token is null and lead the lesser set."""
    kinds = ("<u4", "<u2", np.int64, np.uint8, np.uint8, np.int64)

    def rows(token: np.ndarray, sid: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(token.astype(np.int64)), pa.array(sid), pa.array(lead)], names=["token", "sid", "lead"])

    def pairs(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(held, 1)
        o = np.lexsort((b, a))
        a, b = a[o], b[o]
        once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        return pa.record_batch([pa.nulls(int(once.sum()), pa.int64()), pa.array(b[once]), pa.array(a[once])], names=["token", "sid", "lead"])

    def settle(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        low, high, sid, size, most = (np.concatenate([h[k] for h in held]) for k in range(5))
        token = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        o = np.lexsort((sid, token))
        token, sid = token[o], sid[o]
        once = np.append(True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]))
        o, token, sid = o[once], token[once], sid[once]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        counts = np.diff(np.append(starts, len(token)))
        several = np.repeat(counts > 1, counts)
        token, sid, size, most = token[several], sid[several], size[o[several]], most[o[several]]
        counts = counts[counts > 1]
        starts = np.cumsum(counts) - counts
        keep = _partnered(starts, counts, size, most)
        yield rows(token[keep], sid[keep], np.repeat(sid[starts], counts)[keep])
        short, found, n = counts <= SHORT, [], 0
        for i, j in _partners(starts[short], counts[short], size, most):
            found.append(np.stack((sid[i], sid[j])))
            n += len(i)
            if n > 4 * PACK:
                yield pairs(found)
                found, n = [], 0
        if n:
            yield pairs(found)

    held, at = [], None
    for batch in batches:
        for r, *raw in zip(*(c.to_pylist() for c in batch.columns)):
            parts = [None if x is None else np.frombuffer(x, k) for x, k in zip(raw, kinds)]
            if r < 0:
                yield rows(parts[0].astype(np.uint64) | parts[1].astype(np.uint64) << np.uint64(32), parts[2], parts[5])
                continue
            if r != at and held:
                yield from settle(held)
                held = []
            at = r
            held.append(parts)
    if held:
        yield from settle(held)


def _differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        size = min(len(x), len(y))
        out[i] = np.bitwise_count(narrowed(np.frombuffer(x, np.uint8), size) ^ narrowed(np.frombuffer(y, np.uint8), size)).sum()
    return out


def _by_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
        ok = may_link(n, m, _differ(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
        yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _by_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        ok = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.sort(np.concatenate((s, t)), kind="stable")  # merges two sorted runs
            overlap = int((both[1:] == both[:-1]).sum())
            ok[k] = 100 * overlap >= 80 * (len(s) + len(t) - overlap)
        yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2^bits places for a column `at` of hashes; 2^25 places at most, half a million rows to the driver."""
    place = hashes.select(F.col("at").bitwiseAND((1 << bits) - 1).alias("bit"))
    words = place.selectExpr("shiftright(bit, 5) AS word", "shiftleft(1L, CAST(bit & 31 AS INT)) AS mask")
    out = np.zeros(1 << bits - 5, np.uint32)
    for batch in words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out


def arrays_of(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """sid, s: the arrays of the wanted sets (sid, at), computed anew from texts whose hash passes a filter.

    The filter has 16 places for each wanted set up to 2^25; beyond that more texts are read in vain, with the same result. A
    text is known by the name of its own set, so the order of the rows doesn't matter.
    """
    bits = min(max(16, (16 * wanted.count()).bit_length()), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = Words(), _Seen()
        for batch in batches:
            h = batch.column(1).to_numpy() & (1 << bits) - 1
            hit = batch.filter(pa.array((shared.value[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)))
            for rows in _slices([hit]):
                got = [shingles(x, memo) for x in rows.column(0).to_pylist()]
                got = [(i, s) for s in got if len(s) and seen.new(i := set_id(s))]
                yield pa.record_batch([pa.array([i for i, _ in got], pa.int64()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["sid", "s"])

    found = docs.select(text, F.xxhash64(text)).mapInArrow(run, "sid long, s binary")
    return written(found.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "arrays")


def _pairs_with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    left = table.select(F.col("sid").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = table.select(F.col("sid").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(left, "a").join(right, "b")


def _band(n: str) -> Column:
    """Sizes of a link differ by a factor of 1.25 at most, so they lie in one band or in neighbours."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(1.2501))).cast("int")


def _tiles(rows: DataFrame) -> DataFrame:
    """rows (token, sid, n, label, band, below) -> one row for each tile (b, i, j) of token that it goes into.

    Tile b holds bands b and b + 1, so a row goes into two; into the lower one only if the token may have rows of that band. Only a band of more than BLOCK rows is cut: its k blocks, and those
    of the next band, meet pairwise in the tiles i <= j of k + (blocks of the next band) blocks.
    """
    counts = rows.groupBy("token", "band").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    large = counts.select("token", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    here = rows.withColumn("b", F.explode(F.when(F.col("below"), F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array("band"))))
    low = large.select("token", F.col("band").alias("b"), F.col("k").alias("k0"))
    high = large.select("token", (F.col("band") - 1).alias("b"), F.col("k").alias("k1"))
    here = here.join(low.join(high, ["token", "b"], "full"), ["token", "b"], "left").na.fill(1, ["k0", "k1"])
    h = F.xxhash64("sid", F.lit(7))
    block = F.when(F.col("band") == F.col("b"), F.pmod(h, F.col("k0"))).otherwise(F.col("k0") + F.pmod(h, F.col("k1"))).cast("int")
    here = here.withColumn("mine", F.when((F.col("k0") == 1) & (F.col("k1") == 1), 0).otherwise(block))
    blocks = F.when((F.col("k0") == 1) & (F.col("k1") == 1), 1).otherwise(F.col("k0") + F.col("k1"))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j")))
    # the blocks of the higher band meet each other in the tile of their own band
    wanted = F.filter(others, lambda t: (blocks == 1) | (t["i"] < F.col("k0")))
    return here.select("token", "b", F.explode(wanted).alias("t"), "sid", "n", "label", "band").select("token", "b", "t.i", "t.j", "sid", "n", "label", "band")


def _tile_pairs(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of their tiles (token, b, i, j) -> pairs of different labels that the bitmaps let through.

    Without a column keys: only so many of a tile's pairs that they join what its pairs join (stars around rows in an order
    of the token's own), and, for each row that is in a pair left out, a row (sid, null, token). With keys, the sorted tokens of each row up to the tile's: all of the tile's
    pairs whose least common token is this one.
    """
    whole = "keys" in names

    def candidates(b: int, n: np.ndarray, label: np.ndarray, band: np.ndarray, ends: np.ndarray, maps: np.ndarray) -> dict[int, np.ndarray]:
        """Row -> the later rows of other labels that its bitmap lets through, for rows in the order of their sizes."""
        near = {}
        rows = np.flatnonzero((band == b) & (ends > np.arange(1, len(n) + 1)))  # sizes ascend: a pair's smaller set is in band b
        step = max(1, MATRIX // maps.size)
        for k in range(0, len(rows), step):
            i = rows[k : k + step, None]
            j = np.arange(i[0, 0] + 1, ends[i[-1, 0]])
            hit = (j > i) & (j < ends[i]) & (label[j] != label[i])
            hit &= may_link(n[i], n[j], np.bitwise_count(maps[j] ^ maps[i]).sum(2, dtype=np.int64))
            for x in np.flatnonzero(hit.any(1)).tolist():
                near[int(i[x, 0])] = j[hit[x]]
        return near

    def settle(token: int, b: int, ids: np.ndarray, n: np.ndarray, label: np.ndarray, band: np.ndarray, wide: list) -> list[tuple]:
        order = np.lexsort((ids, n))
        ids, n, label, band = (x[order] for x in (ids, n, label, band))
        maps = wide[0].to_pylist()
        size = min(map(len, maps))
        maps = np.stack([narrowed(np.frombuffer(maps[k], np.uint8), size) for k in order]).view(np.uint64)
        ends = np.searchsorted(n, n * 5 // 4, side="right")
        part = label.copy()
        found = None
        out, more = [], np.zeros(len(n), bool)
        near = candidates(b, n, label, band, ends, maps)
        for i in np.random.default_rng(token & 0xFFFFFFFF).permutation(len(n)).tolist() if len(n) > 8 else list(near):
            if i not in near:
                continue
            at, end = near[i], int(ends[i])
            if whole:
                if found is None:
                    upto = [wide[1][k].values.to_numpy() for k in order.tolist()]  # token is the last of each
                    starts = np.cumsum([0, *map(len, upto)])
                    found, at_key = np.unique(np.concatenate(upto), return_inverse=True)
                    mark = np.zeros(len(found), bool)
                mine = at_key[starts[i] : starts[i + 1] - 1]
                mark[mine] = True
                earlier = np.logical_or.reduceat(mark[at_key[starts[i + 1] : starts[end]]], starts[i + 1 : end] - starts[i + 1])
                mark[mine] = False
                at = at[~earlier[at - i - 1]]
            else:
                parts, first = np.unique(part[at], return_index=True)
                fresh_part = parts != part[i]
                left_out = np.delete(at, first[fresh_part])
                if len(left_out):
                    more[i] = more[left_out] = True
                at, parts = at[first[fresh_part]], parts[fresh_part]
                part[np.isin(part, parts)] = part[i]
            out += [(min(x, int(ids[i])), max(x, int(ids[i])), None) for x in ids[at].tolist()]
        return out + [(x, None, token) for x in ids[more].tolist()]

    def tiles(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """What the tiles that begin at starts give; those of one label, or without a smaller set of band b, give nothing."""
        token, b, _, _, ids, n, label, band = (rows.column(k).to_numpy() for k in range(8))
        ends = np.append(starts[1:], rows.num_rows)
        worth = np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
        worth &= np.logical_or.reduceat(band == b, starts)
        pairs: set = set()
        for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
            pairs.update(settle(int(token[s]), int(b[s]), *(x[s:e] for x in (ids, n, label, band)), [c.slice(s, e - s) for c in rows.columns[8:]]))
        return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in range(3)], names=["a", "b", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last tile, which may go on in the next batch
        for batch in batches:
            if held is not None and batch.num_rows:
                batch = pa.concat_batches([held, batch])
            if batch.num_rows:
                places = np.stack([batch.column(k).to_numpy() for k in range(4)])
                starts = np.append(0, np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1)
                held = batch.slice(int(starts[-1]))
                if len(starts) > 1:
                    yield tiles(batch.slice(0, int(starts[-1])), starts[:-1])
        if held is not None:
            yield tiles(held, np.zeros(1, np.int64))

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of tokens that hold more than one label, with band, and below: whether the token has rows of the band below.

    Bands are noted modulo 64, so a token with sizes more than a millionfold apart may have tiles in vain.
    """
    rows = rows.withColumn("band", _band("n"))
    bands = F.expr("bit_or(shiftleft(1L, pmod(band, 64)))")
    several = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), bands.alias("bands")).where("lo < hi")
    below = F.expr("shiftright(bands, pmod(band - 1, 64)) & 1 = 1").alias("below")
    return rows.join(several.select("token", "bands"), "token").select("token", "sid", "n", "label", "band", below)


def _in_tiles(labelled: DataFrame, maps: DataFrame) -> DataFrame:
    """labelled (token, sid, n, label), maps (sid, map, perhaps keys) -> what _tile_pairs finds in the tiles."""
    rest = written(_mixed(labelled), "rest")
    wide = [c for c in ("map", "keys") if c in maps.columns]
    names = ["token", "b", "i", "j"]
    dealt = _tiles(rest).join(maps.select("sid", *wide), "sid").select(*names, "sid", "n", "label", "band", *wide)
    if "keys" in wide:  # only those up to the tile's own are looked at
        dealt = dealt.withColumn("keys", F.slice("keys", 1, F.array_position("keys", F.col("token")).cast("int")))
    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(_tile_pairs(wide), "a long, b long, token long")


def linked(docs: DataFrame, place: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """place, key, n, label for every document: label is null without words, and the same for all that links connect."""
    docs = docs.select(place, key, text)
    sets = written(described(docs, place, key, text), "sets")
    named_sets = sets.where("token IS NULL").select("place", "key", "sid", "n")
    shown = sets.where("map IS NOT NULL")
    maps = written(shown.groupBy("sid").agg(F.min("n").alias("n"), F.min("at").alias("at"), F.min("map").alias("map")), "maps")  # several tasks may show a set, with the same map
    one = maps.select("sid", "at")
    total = shown.agg(F.coalesce(F.sum(F.expr("n - ceil(0.8D * n) + 1")), F.lit(0))).first()[0]
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // RANGE)
    packs = packed_keys(docs, common_shingles(sets), ranges, text).repartition("range").sortWithinPartitions("range")
    rows = written(packs.mapInArrow(_shared, "token long, sid long, lead long"), "keys")

    def settled(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) that the bitmaps let through."""
        pairs = written(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = written(one.join(ids, "sid"), "wanted")
        s = arrays_of(docs, wanted, text)
        out = written(_pairs_with(pairs, s, ["s"]).select("a", "b", "s_a", "s_b").mapInArrow(_by_arrays, "a long, b long"), "links")
        discard(pairs, wanted, s)
        return out

    def passed(pairs: DataFrame) -> DataFrame:
        near = _pairs_with(pairs, maps, ["n", "map"]).where("4 * n_a <= 5 * n_b AND 4 * n_b <= 5 * n_a")
        return near.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(_by_bitmap, "a long, b long")

    met = written(rows.where("token IS NULL").select("sid", "lead").distinct(), "met")
    rows_of_tiles = rows.where("token IS NOT NULL")
    leads = F.slice(F.sort_array(F.collect_set("lead")), 1, TRIES)  # of the set's own keys, so bounded by SHORT times its length
    tries = rows_of_tiles.where("sid <> lead").select("sid", "lead").union(met).groupBy("sid").agg(leads.alias("leads"))
    tries = written(tries.select(F.explode("leads").alias("a"), F.col("sid").alias("b")), "tries")
    links = settled(passed(tries))
    roots = written(components(links), "roots")
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    left = met.select(F.col("lead").alias("a"), F.col("sid").alias("b")).join(tries, ["a", "b"], "left_anti")
    left = left.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    named = maps.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "n", F.coalesce("root", "sid").alias("label"))
    labelled = rows_of_tiles.select("token", "sid").distinct().join(named, "sid")
    tried = written(_in_tiles(labelled, maps), "tried")
    discard(rows)
    roots = written(extended(roots, settled(tried.where("b IS NOT NULL").select("a", "b").union(passed(left)))), "roots")
    discard(met, tries)
    open_ = written(tried.where("b IS NULL").select("token", F.col("a").alias("sid")).distinct(), "open")
    named = maps.select("sid", "n").join(roots, F.col("sid") == F.col("node"), "left").select("sid", "n", F.coalesce("root", "sid").alias("label"))
    labelled = written(_mixed(open_.join(named, "sid")).select("token", "sid", "n", "label"), "labelled")
    keys = labelled.groupBy("sid").agg(F.sort_array(F.collect_list("token")).alias("keys"))
    rest = settled(_in_tiles(labelled, maps.select("sid", "map").join(keys, "sid")).select("a", "b"))
    roots = extended(roots, rest)
    out = named_sets.join(roots, F.col("sid") == F.col("node"), "left")
    return out.select("place", "key", "n", F.coalesce("root", "sid").alias("label"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    place = fresh("_place", docs.columns)
    rows = written(linked(docs.withColumn(place, F.lit(0).cast("long")), place, key, text), "labels")
    names = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("component_id"))
    out = rows.join(names, "label", "left")
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def without_near_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One document of each group stays, that with the least key (of ties, the first): with the columns of docs, a stored table,
    whose rows are known by their places in both readings."""
    place = fresh("_place", docs.columns)
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    rows = written(linked(placed, place, key), "labels")
    first = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("place"))).alias("best"), F.count("*").alias("n"))
    gone = rows.join(first.where("n > 1"), "label").where(F.col("best.place") != F.col("place")).select(F.col("place").alias(place))
    return placed.join(gone, place, "left_anti").select(*docs.columns)
