"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A text gets a blank in front and its blanks become the vocabulary's space sign. It is then cut between two characters that
stand together in no piece: no merge can cross there, so each distinct chunk of a batch is worked once. Inside a chunk an
agenda holds the adjacent pairs of symbols that make up a piece; the pair of the best score is merged first, the leftmost
among equals, and its new neighbours enter the agenda. Agendas of many short chunks advance side by side, one pop of each
in a round, in numpy; a long chunk has a heap of its own, so that n characters cost n log n. A character without a
piece becomes its UTF-8 bytes' pieces.

Every chunk that a worker works out is checked against the sentencepiece library in the same Arrow batch: the fresh chunks
of the batch are joined by a character that no merge touches and encoded by the library; any difference is an error.
Vocabularies must have pieces for all 256 bytes and no unused ones; other kinds are refused.

Null and empty texts have no tokens. Texts of any length are handled whole. Repeated rows each have their row. Of equal
scores the leftmost pair is merged. An empty table gives an empty result. Extra columns are ignored, whatever their names.
Decoding ids outside of the vocabulary is an error; null ids decode to an empty text; bytes that form no character
become U+FFFD each.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.chunks import Ragged, Remembered, codepoints, gathered, parted, ragged_strings
from frontrank.llm.common import filled, read, small_batches, texts

SPACE = "▁"
#: Chunks of more symbols have a heap of their own.
SIDE_BY_SIDE = 48
#: Chunks that the library gets in one string.
TOGETHER = 4096
_PROBE, _NEVER, _CODES = "ﬁ  a é b ", np.int64(1) << 62, 0x110000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """The pieces of a model as arrays: symbols are piece ids, and behind them characters that have no piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.byte_ids = np.array([i for i in range(n) if sp.is_byte(i)], np.int64)
        if len(self.byte_ids) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the vocabulary must have a piece for each byte and none that is unused")
        self.ids = {p: i for i, p in enumerate(names) if not (special[i] or sp.is_byte(i))}
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        merges = {(self.symbol(p[:k]), self.symbol(p[k:])): i for p, i in self.ids.items() for k in range(1, len(p)) if all(len(x) == 1 or x in self.ids for x in (p[:k], p[k:]))}
        keys = np.array([a * (n + _CODES) + b for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = np.append(keys[order], _NEVER), np.append(np.array(list(merges.values()), np.int64)[order], 0)
        self.merge_of = merges
        alphabet = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.letter = np.zeros(_CODES, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.joins = np.zeros((len(alphabet) + 1,) * 2, bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.joins[self.letter[ord(a)], self.letter[ord(b)]] = True
        self.single = np.arange(n, n + _CODES, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.border = next(c for c in map(chr, [10, *range(1, 32)]) if not self.letter[ord(c)])
        self.normal = sp.normalize(_PROBE) == SPACE + _PROBE.replace(" ", SPACE)
        self.surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for value, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([value])
        self.opens = np.array([p.startswith(SPACE) for p in names])
        self.flat_surface, self.surface_sizes = ragged_strings(self.surface)
        self.memory = Remembered(self.fresh)

    def symbol(self, piece: str) -> int:
        return self.ids.get(piece, -1) if len(piece) > 1 else self.ids.get(piece, self.size + ord(piece))

    def prepared(self, text: str) -> str:
        return "" if not text else SPACE + text.replace(" ", SPACE) if self.normal else self.library.normalize(text)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each character, whether no piece has it together with the one before."""
        at = self.letter[codes]
        return np.concatenate([np.ones(min(1, len(at)), bool), ~self.joins[at[:-1], at[1:]]])

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs make up a piece, and that piece."""
        key = left * (self.size + _CODES) + right
        at = np.searchsorted(self.keys, key)
        return self.keys[at] == key, self.merged[at]

    def side_by_side(self, symbols: np.ndarray, sizes: np.ndarray) -> Ragged:
        """Merges of many chunks; in a round each chunk's agenda gives its best pair."""
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.int64(SIDE_BY_SIDE + 1)
        made, key = np.zeros(len(symbols), np.int64), np.full(len(symbols), _NEVER)

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at `at` on the agenda."""
            key[at] = _NEVER
            at = at[at + 1 < len(symbols)]
            at = at[chunk[at] == chunk[at + 1]]
            hit, piece = self.found(symbols[at], symbols[at + 1])
            at, piece = at[hit], piece[hit]
            made[at], key[at] = piece, self.rank[piece] * wide + place[at]

        enter(np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.diff(chunk, prepend=-1))
            best = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(chunk))))
            open_ = best < _NEVER
            done.append((chunk[~open_], symbols[~open_]))
            first = np.flatnonzero(open_ & (key == best))
            symbols = symbols.copy()
            symbols[first] = made[first]
            stay = open_.copy()
            stay[first + 1] = False
            now = np.cumsum(stay) - 1
            symbols, chunk, place, made, key = symbols[stay], chunk[stay], place[stay], made[stay], key[stay]
            changed = now[first]
            enter(np.concatenate([changed, changed[changed > 0] - 1]))
        owner, out = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return out[order], np.bincount(owner, minlength=len(sizes)).astype(np.int64)

    def by_heap(self, symbols: list[int]) -> list[int]:
        """Merges of one chunk of any length."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            piece = self.merge_of.get((symbols[i], symbols[j]))
            if piece is not None:
                heapq.heappush(agenda, (int(self.rank[piece]), i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            enter(i, i + 1)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = self.merge_of[left, right], -1
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
                enter(i, after[j])
            if before[i] >= 0:
                enter(before[i], i)
        return [s for s in symbols if s >= 0]

    def spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> Ragged:
        """Ids: characters without a piece become the pieces of their bytes."""
        strange = np.flatnonzero(symbols >= self.size)
        if not len(strange):
            return symbols.astype(np.int32), sizes
        spelt = [self.byte_ids[list(chr(c).encode())] for c in (symbols[strange] - self.size).tolist()]
        count = np.ones(len(symbols), np.int64)
        count[strange] = [len(x) for x in spelt]
        out = np.repeat(symbols, count)
        out[np.repeat(symbols >= self.size, count)] = np.concatenate(spelt)
        until = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(sizes)
        return out.astype(np.int32), until[ends] - until[ends - sizes]

    def fresh(self, chunks: pa.Array) -> list[Ragged]:
        """Ids of chunks, checked against the library."""
        found = self.merge(chunks)
        self.check(chunks, *found)
        return [found]

    def merge(self, chunks: pa.Array) -> Ragged:
        """Ids of chunks."""
        joined = "".join(chunks.to_pylist())
        symbols, sizes = self.single[codepoints(joined)], np.asarray(pc.utf8_length(chunks), np.int64)
        short = sizes <= SIDE_BY_SIDE
        ids, counts = self.side_by_side(symbols[np.repeat(short, sizes)], sizes[short])
        merged = np.zeros(len(sizes), np.int64)
        merged[short] = counts
        if not short.all():
            begin = np.cumsum(sizes) - sizes
            each = [self.by_heap(symbols[begin[i] : begin[i] + sizes[i]].tolist()) for i in np.flatnonzero(~short).tolist()]
            merged[~short] = [len(x) for x in each]
            out = np.empty(merged.sum(), np.int64)
            out[np.repeat(short, merged)] = ids
            out[np.repeat(~short, merged)] = np.concatenate(each)
            ids = out
        return self.spelled(ids, merged)

    def check(self, chunks: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """An error where the library's ids of any of these chunks are others."""
        if not self.normal:
            return  # chunks are normalised, and the library would normalise them again; `differing` compares whole texts
        *front, between = self.library.encode(self.border)
        until = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(0, len(chunks), TOGETHER):
            some = chunks.slice(i, TOGETHER).to_pylist()
            known = self.library.encode((self.border + self.border.join(some)).replace(SPACE, " "), num_threads=1)
            own = np.insert(ids[until[i] : until[i + len(some)]], until[i : i + len(some)] - until[i], between)
            if front + own.tolist() != known:
                raise RuntimeError(f"ids differ from the library's among the chunks from {some[0]!r} to {some[-1]!r}")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the offsets of each text."""
        ready = [self.prepared(t) for t in column.to_pylist()]
        joined = "".join(ready)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(ready) + 1, np.int64)
        codes, ends = codepoints(joined), np.cumsum([len(t) for t in ready])
        cut = self.cuts(codes)
        cut[ends[:-1][ends[:-1] < len(codes)]] = True
        starts = np.flatnonzero(cut)
        chunks = pc.dictionary_encode(parted(joined, codes, starts))
        flat, begin, count = self.memory.of(chunks.dictionary)[0]
        which = np.asarray(chunks.indices, np.int64)
        until = np.concatenate([[0], np.cumsum(count[which])])
        return gathered(flat, count, which, begin), np.concatenate([[0], until[np.searchsorted(starts, ends)]])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each list of ids; the blank that encoding put in front goes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside of the vocabulary")
        data = gathered(self.flat_surface, self.surface_sizes, ids).tobytes()
        until = np.concatenate([[0], np.cumsum(self.surface_sizes[ids])])[offsets].tolist()
        shown = self.surface_sizes[ids] > 0
        skip = np.zeros(len(offsets) - 1, np.int64)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            place = np.where(shown, np.arange(len(ids)), len(ids))
            first = np.minimum.reduceat(place, offsets[full])  # runs of lists without ids hold nothing
            inside = first < offsets[full + 1]
            skip[full[inside]] = self.opens[ids[first[inside]]]
        return [data[a + s : b].decode("utf-8", "each_byte") for a, b, s in zip(until, until[1:], skip.tolist(), strict=False)]


_workers: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own, with what it remembers."""
    return _workers.get(path) or _workers.setdefault(path, Vocabulary(path))


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encoded(docs: DataFrame, model: str, and_decoded: bool = False) -> DataFrame:
    """doc_id and the ids of each text; and_decoded: what these ids decode to, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in filled(batches):
            ids, offsets = words.encode(texts(batch.column(1)))
            out = [batch.column(0).cast(pa.int64()), id_lists(ids, offsets)]
            if and_decoded:
                out.append(pa.array(words.decode(ids, offsets), pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * and_decoded)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and the text that each row's ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            lists = pc.fill_null(batch.column(1).cast(pa.list_(pa.int64())), [])
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            ids = np.asarray(lists.flatten().drop_null(), np.int64)
            if len(ids) != sizes.sum():
                raise ValueError("an id is null")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(words.decode(ids, np.concatenate([[0], np.cumsum(sizes)])), pa.string())], ["doc_id", "text"])

    return small_batches(rows).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def differing(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, own and library ids of the texts that the library encodes to other ids, or decodes to another text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in filled(batches):
            column = texts(batch.column(1))
            ids, offsets = words.encode(column)
            back, known = words.decode(ids, offsets), words.library.encode(column.to_pylist(), num_threads=1)
            own = [ids[a:b].tolist() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            bad = [i for i, x in enumerate(own) if x != known[i] or back[i] != words.library.decode(known[i])]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(bad, pa.int64())), pa.array([own[i] for i in bad], kind), pa.array([known[i] for i in bad], kind)], ["doc_id", "own", "library"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, own array<int>, library array<int>")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encoded(read(spark, sf_dir, "documents"), model_file(), and_decoded=True)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
