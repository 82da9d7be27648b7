"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check of shingles.

For each benchmark item every window of the item's number of words is a candidate passage of a document, as long as it
holds one of the item's key shingles (five words each). A window of similarity THRESHOLD misses at most 1 - THRESHOLD of
an item's shingles, so any shingles that make up more than that will do as keys; the rarest in the documents are taken,
and an item whose rarest ones occur nowhere is out. A window's SimHash is the sign of the sum of its shingles' bits, each
as often as the shingle occurs; sums over windows are differences of running sums. Fingerprints are cut into BLOCKS
blocks. Two that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS bits in some block, so an index of each
block lists, for each value, the items within that distance: the union of what is looked up loses none within RADIUS.
These are checked by their full distance, then by the exact multiset Jaccard similarity of window and item, which must
reach THRESHOLD. (A similarity of 0.8 means about 10 of 64 bits; RADIUS is over 4 standard deviations more.) Items of
fewer than five words use one shingle of all their words; a text shorter than an item is one window.

The benchmark stays on Spark. Documents are read once, whatever its size: a bit map of its shingles (at most 1 <<
MOST_BITS bits) goes to the tasks, and the stretches around runs of shingles that it lets through are written, in pieces
of bounded length; equal pieces (copies) are looked at once. Pieces meet items by their key shingles in a join, where the
bit map's false hits fall away. Documents themselves are never shuffled.

Null and empty texts hold no passage, empty items match nothing; an item without an id is compared like any other. Of
windows that tie, the first counts. Rows that repeat give results that repeat. An empty table gives an empty result (no
document is dropped if the benchmark is empty). Extra columns are passed through by `decontaminated` and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontrank.llm.chunks import gathered
from frontrank.llm.common import SHINGLE, bag, bag_jaccard, read, shingle_hashes, slices, small_batches, texts, word_hashes, written
from frontrank.sources.tables import Scratch

THRESHOLD, RADIUS, BLOCKS = 0.8, 23, 8
#: Windows times items that are looked at together in a piece.
WINDOWS = 1 << 20
#: A window of the threshold that has nine shingles or more holds a run of this many shingles of the benchmark.
RUN = 4
#: Bits for each shingle in the bit map, and the smallest and largest map as powers of two (the largest is 8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 13, 26
#: Places in a piece beside those that it shares with the next.
PIECE = 4096
#: Rows of a few numbers up to which a table is broadcast.
BROADCAST_ROWS = 500_000
_FOUND = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
_ITEMS = "what long, k int, size int, print binary, hashes array<long>, counts array<int>"
_REGIONS = "row long, doc_id long, whole long, bytes long, rid binary, k int, most int, start int, hashes array<long>, hits array<long>"
_MATCHES = "rid binary, what long, at int, n_words int, hamming int, similarity double"
_FLIPS = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """(n + 1, 64) running sums of +1 and -1 for each shingle's bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(n, 8) bytes of the SimHash for each row of bit sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


def in_reach(starts: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Sorted starts in runs that lie within so many places, so that sums and tables stay small in a text of any length."""
    begin = 0
    while begin < len(starts):
        end = int(np.searchsorted(starts, starts[begin] + reach))
        yield starts[begin:end]
        begin = end


class BlockIndex:
    """Fingerprints by block: for each value of a block, the items that differ from it in at most RADIUS // BLOCKS bits."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints, self.blocks = prints, []
        for j in range(BLOCKS):
            value, item = np.nonzero(_FLIPS[:, prints[:, j]] <= RADIUS // BLOCKS)
            count = np.bincount(value, minlength=256)
            self.blocks.append((item, count, np.cumsum(count) - count))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items and distances of all pairs within RADIUS, in order of windows."""
        found = [np.repeat(np.arange(len(prints)), count[prints[:, j]]) * len(self.prints) + gathered(item, count, prints[:, j], begin) for j, (item, count, begin) in enumerate(self.blocks)]
        window, item = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
        away = _FLIPS[prints[window], self.prints[item]].sum(axis=1)
        close = away <= RADIUS
        return window[close], item[close], away[close]


class Item(NamedTuple):
    """A benchmark item as a piece meets it: shingle places, SimHash, bag of shingles and the keys that the piece holds."""

    what: int
    size: int
    print: bytes
    bag: tuple[np.ndarray, np.ndarray]
    keys: np.ndarray


def passages(region: np.ndarray, most: int, items: list[Item]) -> Iterator[tuple]:
    """(what, start, shingles, distance, similarity) of the best window for each item found in a piece of a document.

    most: shingles of the whole document, or of the longest item if it has more.
    """
    by_span: dict[int, list[Item]] = defaultdict(list)
    for i in items:
        by_span[min(i.size, most)].append(i)
    for span, own in sorted(by_span.items()):
        n = len(region) - span + 1
        if n <= 0:
            continue
        places = np.flatnonzero(np.isin(region, np.concatenate([i.keys for i in own])))
        edges = np.bincount(np.maximum(places - span + 1, 0), minlength=len(region) + 1) - np.bincount(places + 1, minlength=len(region) + 1)
        starts = np.flatnonzero(np.cumsum(edges)[:n] > 0)
        index = BlockIndex(np.frombuffer(b"".join(i.print for i in own), np.uint8).reshape(-1, 8))
        best: dict[int, tuple] = {}
        for some in in_reach(starts, max(256, WINDOWS // len(own))):
            first = int(some[0])
            sums = bit_sums(region[first : int(some[-1]) + span])
            window, which, away = index.near(fingerprints(sums[some - first + span] - sums[some - first]))
            for x, i, d in zip(some[window].tolist(), which.tolist(), away.tolist(), strict=True):
                similar = bag_jaccard(own[i].bag, np.unique(region[x : x + span], return_counts=True))
                if similar >= THRESHOLD - 1e-9 and (i not in best or similar > best[i][4]):
                    best[i] = (own[i].what, x, span, d, similar)
        yield from best.values()


def listed(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))


def parted(column: pa.Array) -> list[np.ndarray]:
    """Each row's list as hashes."""
    flat, sizes = np.asarray(column.flatten(), np.int64).view(np.uint64), np.asarray(pc.list_value_length(column), np.int64)
    return np.split(flat, np.cumsum(sizes)[:-1])


def item_rows(benchmark: DataFrame) -> DataFrame:
    """A row for each distinct text of the benchmark that has words: its hash, shingle size, places, SimHash and bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, offsets = word_hashes(texts(batch.column(1)))
            rows, sizes, prints, bags = [], [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                if b > a:
                    own = shingle_hashes(words[a:b])
                    rows.append(i)
                    sizes.append((min(SHINGLE, b - a), len(own)))
                    prints.append(fingerprints(bit_sums(own)[-1:])[0].tobytes())
                    bags.append(bag(words[a:b]))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([k for k, _ in sizes], pa.int32()), pa.array([n for _, n in sizes], pa.int32()), pa.array(prints, pa.binary()), listed([b[0] for b in bags], pa.int64()), listed([b[1] for b in bags], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["what", "k", "size", "print", "hashes", "counts"])

    known = benchmark.filter(F.col("text").isNotNull()).select(what().alias("what"), "text").distinct()
    return small_batches(known).mapInArrow(run, _ITEMS)


def what() -> Column:
    """The key of an item: a hash of its text."""
    return F.xxhash64("text")


class BitMap:
    """Which shingles the benchmark may hold: two bits each of a map that Spark fills; its size is bounded."""

    def __init__(self, items: DataFrame, shingles: int) -> None:
        self.bits = 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(shingles * BITS_EACH))))
        mask = F.lit(self.bits - 1)
        h = items.select(F.explode("hashes").alias("h"))
        bit = h.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
        filled = bit.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(one).alias("held")).toArrow()
        self.cells = np.zeros(self.bits >> 6, np.uint64)
        self.cells[filled.column("cell").to_numpy()] = filled.column("held").to_numpy().view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in (hashes, hashes >> np.uint64(32)):
            place = place & np.uint64(self.bits - 1)
            found &= (self.cells[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def stretches(hashes: np.ndarray, hit: np.ndarray, offsets: np.ndarray, k: int, reach: int, run: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, first, end, hit places) of the pieces that hold all windows with a run of hits.

    hit: by place of a shingle in all texts on end; offsets: the texts' words; reach: a window's places but one.
    """
    at = np.flatnonzero(hit)
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = at + k <= offsets[text + 1]
    at, text = at[inside], text[inside]
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    first = np.union1d(first, np.flatnonzero(np.diff(text, prepend=-1)))
    sizes = np.diff(first, append=len(at))
    long = np.repeat(sizes >= run, sizes)
    at, text = at[long], text[long]
    low, high = np.maximum(at - reach, offsets[text]), np.minimum(at + reach, offsets[text + 1] - k)
    begin = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (low > np.concatenate([[-1], high[:-1]]) + 1))
    step = max(PIECE, reach + 1)
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True) if len(at) else ():
        for a in range(int(low[i]), int(high[j - 1]) + 1, step):
            end = min(int(high[j - 1]) + 1, a + step + reach)
            own = at[i:j][(at[i:j] >= a) & (at[i:j] < end)]
            if len(own):
                yield int(text[i]), a, end, own


def regions(docs: DataFrame, sizes: dict[int, tuple[int, int]], held: BitMap) -> DataFrame:
    """Pieces of documents where a passage may be. sizes: fewest and most shingles of an item, by shingle size.

    row tells rows that repeat apart; it holds once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            column = texts(batch.column(1))
            words, offsets = word_hashes(column)
            found = []
            for k, (fewest, longest) in sizes.items():
                if len(words) < k:
                    continue
                hashes = shingle_hashes(words, k)
                for text, a, end, own in stretches(hashes, held.holds(hashes), offsets, k, longest - 1, min(RUN, math.ceil(THRESHOLD * fewest - 1e-9))):
                    piece, most = hashes[a:end], min(longest, int(offsets[text + 1] - offsets[text]) - k + 1)
                    key = xxhash.xxh3_128_digest(piece.tobytes() + most.to_bytes(8, "little") + bytes([k]))
                    found.append((text, key, k, most, a - int(offsets[text]), piece, np.unique(hashes[own])))
            at = np.array([f[0] for f in found], np.int64)
            held_texts = column.take(pa.array(at))
            whole = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in held_texts.to_pylist()), np.uint64, len(at)).view(np.int64)  # as Spark's xxhash64
            plain = [pa.array([f[i] for f in found], t) for i, t in ((1, pa.binary()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            out = [pa.array(at + row), batch.column(0).cast(pa.int64()).take(pa.array(at)), pa.array(whole), pc.binary_length(held_texts).cast(pa.int64()), *plain, listed([f[5] for f in found], pa.int64()), listed([f[6] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "whole", "bytes", "rid", "k", "most", "start", "hashes", "hits"])
            row += batch.num_rows

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, _REGIONS)


def key_shingles(items: DataFrame, pieces: DataFrame) -> DataFrame:
    """(h, what): each item's rarest shingles in the pieces, more of them than a window of the threshold can miss."""
    common = pieces.select(F.explode("hits").alias("h")).groupBy("h").agg(F.count("*").alias("common"))
    each = items.select("what", "size", F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("counts").alias("n"))).alias("e")).select("what", "size", "e.h", "e.n")
    known = each.join(common, "h", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("what").orderBy("common", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = known.withColumn("before", before).filter(F.col("before") <= F.floor(F.col("size") * F.lit(1 - THRESHOLD) + F.lit(1e-6)))
    return chosen.filter("common > 0").select("h", "what")


def compared(pairs: DataFrame) -> DataFrame:
    """The best window of each pair of piece and item that reaches the threshold. Rows of a piece that come together share its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rid, k, most = (col[n].to_pylist() for n in ("rid", "k", "most"))
            region, hashes, keys = (parted(col[n]) for n in ("hashes", "item_hashes", "keys"))
            counts = [c.view(np.int64) for c in parted(col["counts"])]
            items = [Item(*r) for r in zip(*(col[n].to_pylist() for n in ("what", "size", "print")), zip(hashes, counts, strict=True), keys, strict=True)]
            found, i = [], 0
            while i < len(rid):
                j = i
                while j < len(rid) and rid[j] == rid[i]:
                    j += 1
                found += [(rid[i], w, x, span + k[i] - 1, d, s) for w, x, span, d, s in passages(region[i], most[i], items[i:j])]
                i = j
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate(kinds)], ["rid", "what", "at", "n_words", "hamming", "similarity"])

    return small_batches(pairs).mapInArrow(run, _MATCHES)


def few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it is small; above, the join is shuffled and AQE splits hot keys."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= BROADCAST_ROWS else rows


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The written pieces of the documents, and the passages found in them. None if the benchmark has no words."""
    with Scratch(docs.sparkSession) as scratch:
        items = scratch.turn(item_rows(benchmark), "items")
        known = items.groupBy("k").agg(F.min("size"), F.max("size"), F.sum(F.size("hashes"))).collect()  # a row for each of five shingle sizes
        if not known:
            return None
        held = BitMap(items, sum(r[3] for r in known))
        places = written(regions(docs, {r[0]: (r[1], r[2]) for r in known}, held), "regions")
        pieces = scratch.turn(places.groupBy("rid").agg(F.first(F.struct("k", "most", "hashes", "hits")).alias("p")).select("rid", "p.*"), "pieces")
        keys = scratch.turn(key_shingles(items, pieces), "keys")
        pairs = pieces.select("rid", F.explode("hits").alias("h")).join(few(keys), "h").groupBy("rid", "what").agg(F.collect_set("h").alias("keys"))
        met = pairs.join(items.select("what", "size", "print", F.col("hashes").alias("item_hashes"), "counts"), "what")
        return places, written(compared(met.join(pieces.drop("hits"), "rid")), "passages")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, start_word, n_words, hamming, similarity."""
    if (both := matches(docs, benchmark)) is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    places, found = both
    each = places.select("row", "doc_id", "rid", "start").join(few(found), "rid")
    window = F.struct((-F.col("similarity")).alias("far"), (F.col("start") + F.col("at")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "hamming")
    best = each.groupBy("row", "doc_id", "what").agg(F.min(window).alias("w"))
    ids = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), what().alias("what"))
    return best.join(few(ids), "what").select("doc_id", "item_id", "w.start_word", "w.n_words", "w.hamming", (-F.col("w.far")).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a passage of a benchmark item; all columns stay."""
    if (both := matches(docs, benchmark)) is None:
        return docs
    places, found = both
    gone = written(places.select("rid", "whole", "bytes").join(few(found.select("rid").distinct()), "rid").select("whole", "bytes").distinct(), "gone")
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(few(gone), (F.xxhash64(text) == gone["whole"]) & (F.octet_length(text) == gone["bytes"]), "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
