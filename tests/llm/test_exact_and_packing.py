"""Exact dedup and packing against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from frontrank.llm import exact_dedup, packing
from frontrank.llm.common import filled, read


def test_every_row_against_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["same", "", None, f"t{i % 7}", f"u{i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(rows) == 9 and sum(r["kept"] for r in rows) == 5
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 5
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.deduplicated(no_docs).count() == 0


def test_ids_equal_the_tokenizer():
    words = packing.WordIds(packing.tokenizer_file())
    texts = ["Hello, World. it's <|endoftext|> fine.  a\tb\nc d \u0130I Stra\u00dfe \u00e9 e\u0301,x.", "", "x.,y ..., 3.14 'tis don't.I'LL", "<|STARTOFTEXT|> ok", "\u0301abc .a ,b 12,5", "A.B.C"]
    ids, offsets = words.encode(pa.array(texts))
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_best_fit_is_the_tightest():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 50) for _ in range(300)), reverse=True)
    where, offset, opened = packing.best_fit(lengths, packing.Capacities(50), 0, 50)
    room: dict[int, int] = {}
    for n, w, o in zip(lengths, where, offset, strict=True):
        fits = [r for r in room.values() if r >= n]
        assert room.get(w, 50) == (min(fits) if fits else 50) and o == 50 - room.get(w, 50)
        room[w] = room.get(w, 50) - n
    assert opened == len(room) and min(room.values()) >= 0


def test_packing_whole(spark, odd_docs, no_docs):
    rows = packing.best_fit_packing(odd_docs, packing.tokenizer_file()).collect()
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    long = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 4)
    words = packing.WordIds(packing.tokenizer_file())
    ids, _ = words.encode(pa.array(["wort " * 30_000]))
    assert [(p, s, n) for p, s, n, _ in long] == [(i, x, min(4096, len(ids) - x)) for i, x in enumerate(range(0, len(ids), 4096))]
    assert all(c == zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for _, s, n, c in long)
    assert packing.best_fit_packing(no_docs, packing.tokenizer_file()).count() == 0
    packed = packing.sequences(odd_docs, packing.tokenizer_file()).collect()
    assert sum(len(r["ids"]) for r in packed) == sum(r["length"] for r in rows)


def test_words_beyond_memory_and_batches_put_together(monkeypatch):
    texts = [f"Some words {i} and wörd{i}s, more{i}.\nmore{i % 7}" for i in range(300)]
    monkeypatch.setattr(packing, "REMEMBER_BYTES", 200)
    words = packing.WordIds(packing.tokenizer_file())
    for own in (texts[:150], texts[100:]):
        ids, offsets = words.encode(pa.array(own))
        assert words.known.nbytes <= 200 + 8 and len(words.known) == len(words.known_sizes)
        for t, a, b in zip(own, offsets, offsets[1:], strict=False):
            assert ids[a:b].tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]
    parts = [pa.RecordBatch.from_pydict({"text": texts[i : i + 3]}) for i in range(0, 300, 3)]
    out = list(filled(iter(parts), limit=2000))
    assert [t for b in out for t in b["text"].to_pylist()] == texts and 3 < len(out) < 20


def test_sequences_are_as_few_as_can_be(spark):
    rows = packing.best_fit_packing(read(spark, "/root/testdata/sf0.01", "documents"), packing.tokenizer_file()).select("sequence_id", "length").collect()
    fewest = -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert fewest <= len({r["sequence_id"] for r in rows}) <= fewest * 1.001 + 1


def test_collapse_over_batches():
    def batch(shas, keeps):
        n = len(shas)
        cols = [pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(shas, pa.binary()), pa.array([1] * n, pa.int64()), pa.array([1] * n, pa.int64()), pa.array(keeps, pa.int64()), pa.array(keeps, pa.int64()), pa.array([1] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["shard", "run", "sha", "bytes", "check", "keep", "uid", "n"])

    out = pa.Table.from_batches(exact_dedup._collapse(iter([batch([b"a", b"b"], [1, 2]), batch([b"b", b"b", b"c"], [3, 4, 5])])))
    assert out["sha"].to_pylist() == [b"a", b"b", b"c"] and out["n"].to_pylist() == [1, 3, 1] and out["keep"].to_pylist() == [1, 4, 5]
    assert np.array(out["uid"]).tolist() == [1, 4, 5]
