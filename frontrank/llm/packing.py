"""Best-fit packing of tokenised documents into sequences.

Tokens are made by whole words: a text is cut at blanks and line ends (the tokenizer drops white space, so no token
crosses them), each distinct word of a slice of texts is encoded once and its ids gathered for every place it stands at.
A worker remembers the ids of the words it met first, mostly the frequent ones, in Arrow tables of bounded size. Each
document ends with END_ID; only documents longer than a sequence are cut.

Placing is best-fit decreasing. Pieces are dealt by hash into groups of about GROUP pieces; inside a group they come
longest first, and a segment tree over remaining capacities finds the tightest open sequence in log2(capacity) steps.
A group closes with at most a few unfilled sequences, so the cost of working group by group is about one in 10,000.
Only ids, lengths and checksums are shuffled, never tokens.

Pieces of equal length go by doc_id, piece and checksum; sequences of equal room are taken last in, first out. Null and
empty texts are documents of one token. Repeated rows are packed each on its own. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import filled, read, small_batches, texts

CAPACITY, END_ID, GROUP = 4096, 1, 32_768
#: Text encoded together, words that the tokenizer gets at a time, and words in one of its strings.
ENCODE_BYTES, AT_ONCE, TOGETHER = 8 << 20, 4096, 512
#: Bytes of words whose ids a worker remembers.
REMEMBER_BYTES = 16 << 20
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def gathered(flat: np.ndarray, count: np.ndarray, codes: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The runs of flat that codes name, on end. count and begin of run c are at c; without begin, runs lie on end."""
    begin = np.cumsum(count) - count if begin is None else begin
    sizes = count[codes]
    at = np.repeat(begin[codes] - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


class WordIds:
    """Token ids of many texts at once: each distinct word of a slice is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = pa.array([], pa.string())
        self.known_ids, self.known_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def words(self, column: pa.Array) -> pa.ListArray:
        """The words of each text. Cuts only where a token ends anyway: at white space, and before , and . after a letter.

        ASCII capitals are lowered as the tokenizer does, unless the text may hold one of its special strings.
        """
        column = pc.replace_substring(column, "\n", " ")
        if not pc.any(pc.match_substring(column, "<|")).as_py():
            column = pc.replace_substring_regex(pc.ascii_lower(column), r"(\p{L})([.,])", r"\1 \2")
        return pc.split_pattern(column, " ")

    def fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many each word has.

        Words of letters only are one piece to the tokenizer, and each ends with a token that ends a word: they are
        encoded many in a string and parted there.
        """
        plain = np.asarray(pc.match_substring_regex(words, r"^\p{L}+$"), bool)
        sizes, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.int32)]
        order = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        lines = [order[0][i : i + TOGETHER] for i in range(0, len(order[0]), TOGETHER)]
        for i in range(0, len(lines), 16):
            group = lines[i : i + 16]
            texts_ = [words.take(pa.array(x)).to_pylist() for x in group]
            for which, own, e in zip(group, texts_, self.tokenizer.encode_batch_fast([" ".join(t) for t in texts_], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                found = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
                if len(found) != len(which) or found.sum() != len(ids):
                    each = [x.ids for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                    found, ids = np.array([len(x) for x in each]), np.fromiter(chain.from_iterable(each), np.int32)
                sizes[which] = found
                parts.append(ids)
        for i in range(0, len(order[1]), AT_ONCE):
            which = order[1][i : i + AT_ONCE]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(which)).to_pylist(), add_special_tokens=False)]
            sizes[which] = [len(x) for x in each]
            parts.append(np.fromiter(chain.from_iterable(each), np.int32))
        return gathered(np.concatenate(parts), sizes[np.concatenate(order)], np.argsort(np.concatenate(order))), sizes

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and each word's place and number of ids in it; word 0 is the end of a document."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1), np.int64)
        new, seen = np.flatnonzero(place < 0), place >= 0
        met = words.take(pa.array(new))
        ids, sizes = self.fresh(met)
        base, starts = len(self.known_ids), np.cumsum(self.known_sizes) - self.known_sizes
        count, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[seen], begin[seen] = self.known_sizes[place[seen]], starts[place[seen]]
        count[new], begin[new] = sizes, base + np.cumsum(sizes) - sizes
        flat = np.concatenate([self.known_ids, ids, np.array([END_ID], np.int32)])
        room = REMEMBER_BYTES - self.known.nbytes
        if room > 0 and len(new):
            fits = int(np.searchsorted(np.cumsum(np.asarray(pc.binary_length(met)) + 4), room, side="right"))
            self.known = pa.concat_arrays([self.known, met.slice(0, fits)])
            self.known_sizes = np.concatenate([self.known_sizes, sizes[:fits]])
            self.known_ids = np.concatenate([self.known_ids, ids[: int(sizes[:fits].sum())]])
        return flat, np.concatenate([[len(flat) - 1], begin]), np.concatenate([[1], count])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each with END_ID behind it, and the offsets of each text."""
        lists = self.words(column)
        words = pc.dictionary_encode(lists.flatten())
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        flat, begin, count = self.of_words(words.dictionary)
        codes = np.asarray(words.indices, np.int64) + 1 if len(words) else np.zeros(0, np.int64)
        ends = np.asarray(lists.offsets, np.int64)[1:]
        codes = np.insert(codes, ends, 0)
        ends = ends + np.arange(1, len(ends) + 1)
        until = np.cumsum(count[codes])
        return gathered(flat, count, codes, begin), np.concatenate([[0], until[ends - 1]]) if len(ends) else np.zeros(1, np.int64)


_workers: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; with_ids: its token ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(tokenizer_path) or _workers.setdefault(tokenizer_path, WordIds(tokenizer_path))
        for batch in filled(batches, limit=ENCODE_BYTES):
            ids, offsets = words.encode(texts(batch.column(1)))
            raw = ids.astype("<i4").tobytes()
            row, part, begin, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                for j, x in enumerate(range(a, b, CAPACITY)):
                    y = min(x + CAPACITY, b)
                    row.append(i), part.append(j), begin.append(x - a), length.append(y - x), crc.append(zlib.crc32(raw[4 * x : 4 * y]))
            out = [batch.column(0).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(part, pa.int32()), *(pa.array(c, pa.int64()) for c in (begin, length, crc))]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, _PIECE + ", ids array<int>" * with_ids)


class Capacities:
    """A segment tree over remaining capacities: each leaf has the open sequences with just that much room."""

    def __init__(self, capacity: int) -> None:
        self.half = 1 << (capacity).bit_length()
        self.some = bytearray(2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        node = room + self.half
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The room and number of the tightest open sequence with at least this much room; it is taken out."""
        some, node = self.some, least + self.half
        if not some[node]:
            while node > 1 and (node & 1 or not some[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.half:
                node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self.half
        which = self.open[room].pop()
        if not self.open[room]:
            some[node] = 0
            while node > 1 and not some[node ^ 1]:
                node >>= 1
                some[node] = 0
        return room, which


def best_fit(lengths: list[int], tree: Capacities, opened: int, capacity: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset for each length in turn, and the number of sequences opened so far."""
    where, offset = [], []
    for length in lengths:
        room, which = tree.take(length) or (capacity, opened)
        opened += which == opened
        where.append(which), offset.append(capacity - room)
        if room > length:
            tree.put(room - length, which)
    return where, offset, opened


def packed(parts: DataFrame, n_docs: int, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset. n_docs sets the number of groups: all but one piece a document are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, opened, first = Capacities(capacity), 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            where, offset, opened = best_fit(batch.column(at).to_pylist(), tree, opened, capacity)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + x for x in where], pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    at = parts.columns.index("length")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    dealt = parts.repartition(max(1, -(-n_docs // GROUP)), F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    return packed(pieces(docs, tokenizer_path), docs.count())


def sequences(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """sequence_id and the token ids of each full sequence, pieces in order of their offset."""
    placed = packed(pieces(docs, tokenizer_path, with_ids=True), docs.count())
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"), tokenizer_file())
