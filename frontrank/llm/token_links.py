"""Links between the tokens of two tokenizers, counted with inverted pair bitmaps.

A is a byte-level BPE of the tokenizers library, B a merge-type SentencePiece vocabulary; both see a blank and the text.
Texts are cut where both tokenizers end a token whatever stands around (before white space, between kinds of
characters, and only between characters that no piece of B has together), so each distinct chunk of a batch is encoded
and aligned once. Byte offsets where tokens of A and B both end part a chunk into groups; all A-B pairs of a group are links.

The index is inverted: documents are numbered inside of blocks of bounded size, and each pair of ids has, for a block, a
compressed bitmap of the documents that hold it (numbers while they are few, bits beyond), OR-merged from the batches of
the block, with bit planes for how often a document holds it. Popcounts of the bitmaps give a pair's documents and links,
summed over blocks; the maximum for an A id tells the best pairs. Then each posting returns its pair's score to its
documents, block by block. Only bitmaps and counts are shuffled, never links. The blocks are written to the shared folder
first, so that a lost executor can't renumber documents.

Null and empty texts, texts with the space sign U+2581 itself, and texts whose joined tokens of A or B spell other bytes
have no tokens: zeros, and an empty groups_sha256. Repeated rows are documents of their own, also under one id. Pairs with
equal counts are all best. Texts of any length are handled whole; a group is folded by distinct ids where it is long, so
memory follows distinct pairs. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontrank.llm.chunks import Ragged, Remembered, codepoints, gathered, parted, ragged_strings
from frontrank.llm.common import filled, read, small_batches, texts, written
from frontrank.llm.piece_bpe import SPACE, Vocabulary, model_file

#: Documents and bytes of text in a block; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 1 << 16, 32 << 20
#: Bytes of text that are aligned together, and of chunks that a worker remembers.
ALIGN_BYTES, REMEMBER = 4 << 20, 8 << 20
#: Links of a group from which it is folded by distinct ids, and links that are spread out at once.
FOLD, AT_ONCE = 1 << 12, 1 << 22
_DOC = ["n_a", "n_b", "n_groups", "n_links"]
_SCHEMA = "block long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs int, links long, held binary, planes array<binary>"
#: Kinds of characters whose borders the pattern of A cuts at; characters beyond LATIN are of no known kind, but for white space.
LATIN, _LETTER, _NUMBER, _OTHER, _WHITE, _UNKNOWN = 0x250, 0, 1, 2, 3, 4
_WHITE_BEYOND = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_of_sign() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def kinds_of_characters() -> np.ndarray:
    out = np.full(0x110000, _UNKNOWN, np.int8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _WHITE if chr(c).isspace() and not 0x1C <= c <= 0x1F else {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[0x1C:0x20] = _UNKNOWN
    out[_WHITE_BEYOND] = _WHITE
    return out


class Aligner:
    """Groups and links of distinct chunks under both tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(a_path).to_str())
        before = spec["pre_tokenizer"] or {}
        self.a, self.b = Tokenizer.from_file(a_path), Vocabulary(b_path)
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or spec["normalizer"] or not self.b.normal:
            raise ValueError("A must be a byte-level BPE with its pattern, and neither may change the text")
        self.a.encode_special_tokens = True
        signs, names = byte_of_sign(), self.a.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelt[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
        self.a_bytes, self.b_bytes = ragged_strings(spelt), ragged_strings(self.b.surface)
        self.n_b = len(self.b.surface)
        digits = [str(i) for i in range(max(len(spelt), self.n_b))]
        self.digits = ragged_strings([(d + s).encode() for d in digits for s in ",|;"])
        self.kinds = kinds_of_characters()
        self.memory = Remembered(self.fresh, REMEMBER)

    def cuts(self, joined: str, codes: np.ndarray) -> np.ndarray:
        """For each character of texts with the space sign, whether both tokenizers begin a token there in any case."""
        blank = codes == ord(SPACE)
        kind = np.where(blank, np.int8(_WHITE), self.kinds[codes])
        solid = kind != _WHITE
        cut = np.zeros(len(codes), bool)
        unsure = kind == _UNKNOWN
        cut[1:] = (solid[:-1] & ~solid[1:]) | (solid[:-1] & solid[1:] & ~unsure[:-1] & ~unsure[1:] & (kind[:-1] != kind[1:]) & (codes[:-1] != ord("'")))
        if len(codes) > 2:  # a single white-space character that no word takes up
            cut[2:] |= solid[:-2] & ~solid[1:-1] & ~blank[1:-1] & solid[2:]
        cut &= self.b.cuts(codes)
        cut[:1] = True
        return cut

    def links(self, a_ids: np.ndarray, b_ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, how often each is met, and the number of pairs of each group. Pairs may come more than once."""
        of_group = n_a * n_b
        sizes, keys, times = of_group.copy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a_from, b_from = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        many = np.flatnonzero(of_group > FOLD)
        edges = np.unique(np.concatenate([[0, len(of_group)], many, many + 1, np.flatnonzero(np.diff(np.cumsum(np.where(of_group > FOLD, 0, of_group)) // AT_ONCE)) + 1]))
        for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            if hi - lo == 1 and of_group[lo] > FOLD:
                x, x_times = np.unique(a_ids[a_from[lo] : a_from[lo] + n_a[lo]], return_counts=True)
                y, y_times = np.unique(b_ids[b_from[lo] : b_from[lo] + n_b[lo]], return_counts=True)
                keys.append((x.astype(np.int64)[:, None] * self.n_b + y).ravel())
                times.append((x_times[:, None] * y_times).ravel())
                sizes[lo] = len(keys[-1])
                continue
            here = of_group[lo:hi]
            nth = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
            wide = np.repeat(n_b[lo:hi], here)
            keys.append(a_ids[np.repeat(a_from[lo:hi], here) + nth // np.maximum(wide, 1)].astype(np.int64) * self.n_b + b_ids[np.repeat(b_from[lo:hi], here) + nth % np.maximum(wide, 1)])
            times.append(np.ones(len(nth), np.int64))
        return np.concatenate(keys), np.concatenate(times), sizes

    def fresh(self, chunks: pa.Array) -> list[Ragged]:
        """For each chunk: n_a, n_b, n_groups, n_links and whether its bytes are right; its pairs; their numbers; its groups as text."""
        plain = pc.replace_substring(chunks, SPACE, " ")
        each = [e.ids for e in self.a.encode_batch_fast(plain.to_pylist(), add_special_tokens=False)]
        a_sizes = np.fromiter(map(len, each), np.int64, len(each))
        a_ids = np.fromiter((i for ids in each for i in ids), np.int64, int(a_sizes.sum()))
        b_ids, b_sizes = self.b.merge(chunks)
        right = self.right_bytes(plain, a_ids, a_sizes, self.a_bytes) & self.right_bytes(plain, b_ids, b_sizes, self.b_bytes)
        a_ids, b_ids = a_ids[np.repeat(right, a_sizes)], b_ids[np.repeat(right, b_sizes)]
        a_sizes, b_sizes = np.where(right, a_sizes, 0), np.where(right, b_sizes, 0)
        a_ends, b_ends = np.cumsum(self.a_bytes[1][a_ids]), np.cumsum(self.b_bytes[1][b_ids])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
        chunk = np.repeat(np.arange(len(chunks)), a_sizes)[np.cumsum(n_a) - 1] if len(shared) else np.zeros(0, np.int64)
        keys, times, pairs = self.links(a_ids, b_ids, n_a, n_b)
        total = lambda x: np.bincount(chunk, x, len(chunks)).astype(np.int64)
        meta = np.stack([a_sizes, b_sizes, total(np.ones(len(shared))), total(n_a * n_b), right], 1).astype(np.int64)
        mark = np.concatenate([np.where(np.diff(a_group, append=-1) != 0, 1, 0), np.where(np.diff(b_group, append=-1) != 0, 2, 0)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        written_as = (np.concatenate([a_ids, b_ids]) * 3 + mark)[order]
        letters = self.digits[1][written_as]
        owner = np.concatenate([chunk[a_group], chunk[b_group]])[order]
        return [(meta.ravel(), np.full(len(chunks), 5, np.int64)), (keys, total(pairs)), (times, total(pairs)), (gathered(*self.digits, written_as), np.bincount(owner, letters, len(chunks)).astype(np.int64))]

    @staticmethod
    def right_bytes(plain: pa.Array, ids: np.ndarray, sizes: np.ndarray, table: Ragged) -> np.ndarray:
        """Which chunks the ids spell byte for byte."""
        length = np.asarray(pc.binary_length(plain), np.int64)
        until = np.concatenate([[0], np.cumsum(table[1][ids])])
        ends = np.cumsum(sizes)
        right = until[ends] - until[ends - sizes] == length
        if right.any():
            own = gathered(*table, ids[np.repeat(right, sizes)])
            true = np.frombuffer("".join(plain.filter(pa.array(right)).to_pylist()).encode(), np.uint8)
            wrong = np.flatnonzero(own != true)
            right[np.flatnonzero(right)[np.searchsorted(np.cumsum(length[right]), wrong, side="right")]] = False
        return right

    def align(self, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links and groups_sha256 of each text; its pairs, how often, and whose they are."""
        ready = ["" if not t or SPACE in t else SPACE + t.replace(" ", SPACE) for t in column.to_pylist()]
        joined = "".join(ready)
        none = np.zeros(0, np.int64)
        if not joined:
            return np.zeros((len(ready), 4), np.int64), [""] * len(ready), none, none, none
        codes, ends = codepoints(joined), np.cumsum([len(t) for t in ready])
        cut = self.cuts(joined, codes)
        cut[ends[:-1][ends[:-1] < len(codes)]] = True
        starts = np.flatnonzero(cut)
        chunks = pc.dictionary_encode(parted(joined, codes, starts))
        meta, keys, times, groups = self.memory.of(chunks.dictionary)
        which = np.asarray(chunks.indices, np.int64)
        doc = np.searchsorted(ends, starts, side="right")
        each = meta[0].reshape(-1, 5)[meta[1] // 5]
        bad = np.bincount(doc, each[which, 4] == 0, len(ready)) > 0
        which, doc = which[~bad[doc]], doc[~bad[doc]]
        sums = np.zeros((len(ready), 4), np.int64)
        np.add.at(sums, doc, each[which, :4])
        text = gathered(groups[0], groups[2], which, groups[1]).tobytes()
        until = np.cumsum(np.bincount(doc, groups[2][which], len(ready)).astype(np.int64)).tolist()
        shas = [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in zip([0, *until], until, strict=False)]
        pick = lambda x: gathered(x[0], x[2], which, x[1])
        return sums, shas, pick(keys), pick(times), np.repeat(doc, keys[2][which])


_workers: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    return _workers.get((a_path, b_path)) or _workers.setdefault((a_path, b_path), Aligner(a_path, b_path))


def bitmap(slots: np.ndarray, among: int) -> bytes:
    """Slots in order as numbers of two bytes while that is shorter, else as bits; the first byte tells which."""
    if 16 * len(slots) <= among:
        return b"\0" + slots.astype("<u2").tobytes()
    bits = np.zeros(among, np.uint8)
    bits[slots] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def slots_of(held: bytes) -> np.ndarray:
    """What bitmap() holds."""
    data = np.frombuffer(held, np.uint8, offset=1)
    return data.view("<u2").astype(np.int64) if held[0] == 0 else np.flatnonzero(np.unpackbits(data, bitorder="little"))


def popcount(held: bytes) -> int:
    data = np.frombuffer(held, np.uint8, offset=1)
    return len(data) // 2 if held[0] == 0 else int(np.bitwise_count(data).sum())


class Block:
    """Postings of the documents of a block: for each pair a bitmap and planes of how often."""

    def __init__(self, number: int, n_b: int) -> None:
        self.number, self.n_b, self.docs, self.bytes = number, n_b, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, keys: np.ndarray, times: np.ndarray, doc: np.ndarray, docs: int, size: int) -> None:
        """The links of a batch, folded to a (pair, document) each."""
        full = (keys << 16) | (doc + self.docs)
        order = np.argsort(full)
        full = full[order]
        heads = np.flatnonzero(np.diff(full, prepend=-1))
        self.keys.append(full[heads])
        self.times.append(np.add.reduceat(times[order], heads) if len(heads) else times[:0])
        self.docs, self.bytes = self.docs + docs, self.bytes + size

    def postings(self) -> pa.RecordBatch:
        """The batches OR-merged: a, b, docs, links, held, planes of each pair."""
        keys, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.times))
        order = np.argsort(keys, kind="stable")
        keys, more = keys[order], times[order] - 1
        pair, slot = keys >> 16, keys & 0xFFFF
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        ends = np.append(heads[1:], len(pair))
        most = np.maximum.reduceat(more, heads) if len(heads) else more
        held, planes, docs, links = [], [], [], []
        for lo, hi, top in zip(heads.tolist(), ends.tolist(), most.tolist(), strict=True):
            own, extra = slot[lo:hi], more[lo:hi]
            held.append(bitmap(own, self.docs))
            planes.append([bitmap(own[extra >> k & 1 == 1], self.docs) for k in range(top.bit_length())])
            docs.append(popcount(held[-1]))
            links.append(docs[-1] + sum(popcount(p) << k for k, p in enumerate(planes[-1])))
        a, b = np.divmod(pair[heads], self.n_b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(docs, pa.int32()), pa.array(links, pa.int64()), pa.array(held, pa.binary()), pa.array(planes, pa.list_(pa.binary()))], ["a", "b", "docs", "links", "held", "planes"])


def _wide(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def indexed(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document (slot, doc_id, its counts and groups_sha256) and one for each pair of each block (a, b, docs, links, held, planes)."""
    kinds = [("block", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _DOC), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32()), ("links", pa.int64()), ("held", pa.binary()), ("planes", pa.list_(pa.binary()))]
    schema = pa.schema(kinds)

    def closed(block: Block) -> Iterator[pa.RecordBatch]:
        found = block.postings()
        for i in range(0, found.num_rows, 1 << 15):
            part = found.slice(i, 1 << 15)
            yield _wide({"block": pa.array(np.full(part.num_rows, block.number), pa.int64())} | dict(zip(part.schema.names, part.columns, strict=True)), part.num_rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        first = TaskContext.get().partitionId() << 32
        block = Block(first, both.n_b)
        for batch in filled(batches, limit=ALIGN_BYTES):
            column = texts(batch.column(1))
            if block.docs and (block.docs + len(column) > BLOCK_DOCS or block.bytes + column.nbytes > BLOCK_BYTES):
                yield from closed(block)
                block = Block(block.number + 1, both.n_b)
            for i in range(0, len(column), BLOCK_DOCS):  # many empty texts are few bytes
                part = column.slice(i, BLOCK_DOCS)
                if i:
                    yield from closed(block)
                    block = Block(block.number + 1, both.n_b)
                sums, shas, keys, times, doc = both.align(part)
                n = len(part)
                yield _wide({"block": pa.array(np.full(n, block.number), pa.int64()), "slot": pa.array(np.arange(block.docs, block.docs + n), pa.int32()), "doc_id": batch.column(0).slice(i, n).cast(pa.int64()), "groups_sha256": pa.array(shas, pa.string())} | {c: pa.array(sums[:, j], pa.int64()) for j, c in enumerate(_DOC)}, n, schema)
                block.add(keys, times, doc, n, part.nbytes)
        if block.docs:
            yield from closed(block)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, _SCHEMA)


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, the documents and links of each pair, and whether no pair of its A id has more documents."""
    counts = postings.groupBy("a", "b").agg(F.sum("docs").alias("count"), F.sum("links").alias("links"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def returned(scored: DataFrame) -> DataFrame:
    """block, slot, n_best, count_sum: each posting gives its pair's score to its documents, as often as they hold the pair."""

    def run(table: pa.Table) -> pa.Table:
        best, total, block = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64), table.column("block")[0].as_py()
        for batch in table.select(["held", "planes", "count", "best"]).to_batches():
            for held, planes, count, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, bits in [(0, held), *enumerate(planes)]:
                    slots = slots_of(bits)
                    total[slots] += count << k
                    if top:
                        best[slots] += 1 << k
        slots = np.flatnonzero(total)
        return pa.table({"block": pa.array(np.full(len(slots), block), pa.int64()), "slot": pa.array(slots, pa.int32()), "n_best": pa.array(best[slots], pa.int64()), "count_sum": pa.array(total[slots], pa.int64())})

    return scored.select("block", "held", "planes", "count", "best").groupBy("block").applyInArrow(run, "block long, slot int, n_best long, count_sum long")


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    index = written(indexed(docs, a_path, b_path), "token-links")
    postings, rows = index.filter("a IS NOT NULL"), index.filter("slot IS NOT NULL").select("block", "slot", "doc_id", *_DOC, "groups_sha256")
    scores = returned(postings.join(pair_counts(postings).drop("links"), ["a", "b"]))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(scores, ["block", "slot"], "left").select("doc_id", *_DOC, zero("n_best"), zero("count_sum"), "groups_sha256")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(read(spark, sf_dir, "documents"), tokenizer_file(), model_file())
