"""What the operators share: written tables, Arrow text access, word shingles."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.sources.tables import materialized as written  # noqa: F401  (the operators take it from here)

#: Text handled at once inside a task; longer single texts are still handled whole.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to a Python worker at once.
BATCH_ROWS = 1000
SHINGLE = 5
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_ids(docs: DataFrame, ids: DataFrame, n_ids: int, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """Rows of docs whose keys are not in ids. Up to `most` keys are broadcast; above, a shuffled join."""
    return docs.join(F.broadcast(ids) if n_ids <= most else ids, keys, "left_anti")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, however often use names it inside its own lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out(modulus: int, rest: int):
    """Whether crc32 of the id's text leaves this remainder."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == rest, F.lit(False))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one Arrow string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches kept small: ten thousand texts at once would fill a task's memory twice over."""
    conf = docs.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings on end, and the offsets of each string in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def trim() -> None:
    """Gives freed memory back to the system: a worker serves many tasks and should hold only what the current one needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows so that each holds about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                trim()
                begin, held = i, 0
            held += size
        yield batch.slice(begin)
        trim()


def filled(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut and put together by rows so that each holds about `limit` bytes of text, whatever Spark's batches hold."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, limit):
        more = batch.column(batch.schema.get_field_index(column)).nbytes
        if held and size + more > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each lower-cased word between white space, and each text's offsets in them."""
    import xxhash

    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(column)))
    words = pc.dictionary_encode(lists.flatten())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    codes, offsets = np.asarray(words.indices), np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    hashes = table[codes] if len(codes) else np.zeros(0, np.uint64)
    empty = np.asarray(pc.equal(pc.utf8_trim_whitespace(column), ""), bool)
    if empty.any():  # a text without words splits into one empty word
        sizes = np.diff(offsets)
        keep = np.repeat(~empty, sizes)
        hashes, offsets = hashes[keep], np.concatenate([[0], np.cumsum(np.where(empty, 0, sizes))])
    return hashes, offsets


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One hash for each run of k words; fewer than k words make one shingle of all of them."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : n - k + 1 + j]
    return mixed(out + np.uint64(k))


def bag(words: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    return np.unique(shingle_hashes(words, k), return_counts=True)


def bag_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags: shared multiplicity over joint multiplicity; two empty bags give 1."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


PAD = 256


def chunk_starts(sizes: np.ndarray, width: int, stride: int, flush: bool) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of width bytes every stride bytes that cover each text to its end, at least one for each text.

    Gives the number of chunks of each text and each chunk's start in its text. flush: the last one ends with its text.
    """
    counts = np.maximum(1, -(-(sizes - (width - stride)) // stride))
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = nth * stride
    return counts, np.minimum(starts, np.repeat(np.maximum(0, sizes - width), counts)) if flush else starts


def chunk_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """A row of width symbols for each chunk that begins at `begin`; PAD from its text's `end` on."""
    at = begin[:, None] + np.arange(width)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)].astype(np.int16), np.int16(PAD)) if len(data) else np.full(at.shape, PAD, np.int16)


def sampled_chunks(docs: DataFrame, value: str, kind: str, width: int, per_doc: int) -> DataFrame:
    """For fitting: (value, chunk) with at most per_doc chunks of width bytes, spread evenly over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = raw(texts(batch.column(0)))
            values, chunks = [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                n = max(1, min(per_doc, -(-(b - a) // width)))
                for x in np.linspace(a, max(a, b - width), n).astype(int).tolist():
                    values.append(i)
                    chunks.append(data[x : min(b, x + width)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(values)), pa.array(chunks, pa.binary())], ["value", "chunk"])

    return small_batches(docs).select("text", value).mapInArrow(run, f"value {kind}, chunk binary")


def chunk_rows(chunks: list[bytes], width: int) -> np.ndarray:
    """Collected chunks as rows of symbols."""
    out = np.full((len(chunks), width), PAD, np.int16)
    for i, c in enumerate(chunks):
        out[i, : len(c)] = np.frombuffer(c, np.uint8)
    return out


class Adam:
    """Adam steps over a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.w, self.rate, self.n = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-8)
