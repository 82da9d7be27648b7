"""Texts cut into short chunks, and results for distinct chunks that a worker remembers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks whose results a worker remembers.
REMEMBER_BYTES = 16 << 20
#: Values in a row and the number of values of each item.
Ragged = tuple[np.ndarray, np.ndarray]


def gathered(flat: np.ndarray, count: np.ndarray, codes: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The runs of flat that codes name, on end. count and begin of run c are at c; without begin, runs lie on end."""
    begin = np.cumsum(count) - count if begin is None else begin
    sizes = count[codes]
    at = np.repeat(begin[codes] - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


def codepoints(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def parted(joined: str, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces of joined that begin at the characters `starts`, as an Arrow array. The first start is 0."""
    until = np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF))
    offsets = np.append(np.where(starts > 0, until[starts - 1], 0), until[-1] if len(until) else 0).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))


def ragged_strings(items: list[bytes]) -> Ragged:
    return np.frombuffer(b"".join(items), np.uint8), np.fromiter(map(len, items), np.int64, len(items))


class Remembered:
    """Ragged results of distinct strings. What was met first is kept, up to a bound in bytes; the rest is worked out again."""

    def __init__(self, work: Callable[[pa.Array], list[Ragged]], limit: int = REMEMBER_BYTES) -> None:
        self.work, self.limit = work, limit
        self.known, self.kept = pa.array([], pa.string()), None

    def of(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each result its values, and each word's begin and number of values in them."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1), np.int64)
        new, seen = np.flatnonzero(place < 0), place >= 0
        met = words.take(pa.array(new))
        fresh = self.work(met)
        kept = self.kept or [(flat[:0], sizes[:0]) for flat, sizes in fresh]
        out = []
        for (old, old_sizes), (flat, sizes) in zip(kept, fresh, strict=True):
            begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            count[seen], begin[seen] = old_sizes[place[seen]], (np.cumsum(old_sizes) - old_sizes)[place[seen]]
            count[new], begin[new] = sizes, len(old) + np.cumsum(sizes) - sizes
            out.append((np.concatenate([old, flat]), begin, count))
        room = self.limit - self.known.nbytes
        if room > 0 and len(new):
            fits = int(np.searchsorted(np.cumsum(np.asarray(pc.binary_length(met)) + 4), room, side="right"))
            self.known = pa.concat_arrays([self.known, met.slice(0, fits)])
            self.kept = [(np.concatenate([old, flat[: int(sizes[:fits].sum())]]), np.concatenate([old_sizes, sizes[:fits]])) for (old, old_sizes), (flat, sizes) in zip(kept, fresh, strict=True)]
        return out
