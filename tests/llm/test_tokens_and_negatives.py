"""Hard negatives, token links and SentencePiece coding against plain Python and the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frontrank.llm import hard_negatives, piece_bpe, token_links
from frontrank.llm.common import read

SF = "/root/testdata/sf0.001"
SIGNS = [chr(c) for c in range(0x250)] + list("  \n▁　 日本語漢字😀👩‍💻ﬁΩб中�'''stremd")
ODD_TEXTS = ["", " ", "a" * 5000, " " * 777, "▁", "x▁", "ab" * 3000, "<s></s><unk><0x41> <|endoftext|>", "word " * 50, "\n" * 90, "don't 'tis we'll 's", "12345 1 2", "a  b c", "\x00\x01"]


def signs(seed, n=600):
    rng = random.Random(seed)
    return ODD_TEXTS + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(n)] + ["".join(rng.choice("ab  e\n'st12 .,\t ") for _ in range(rng.randrange(150))) for _ in range(n)]


# -- coding -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    return piece_bpe.Vocabulary(piece_bpe.model_file())


def test_ids_and_texts_equal_the_library(words):
    texts = signs(3)
    ids, offsets = words.encode(pa.array(texts))
    known = words.library.encode(texts)
    back = words.decode(ids, offsets)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == known[i], t[:60]
        assert back[i] == words.library.decode(known[i])


def test_both_agendas_merge_alike(words):
    rng = random.Random(5)
    chunks = ["▁" + "".join(rng.choice("abcdetion") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    symbols = [words.single[[ord(c) for c in t]] for t in chunks]
    ids, sizes = words.side_by_side(np.concatenate(symbols), np.array([len(s) for s in symbols]))
    assert np.split(ids, np.cumsum(sizes)[:-1])[7].tolist() == words.by_heap(symbols[7].tolist())
    for own, s in zip(np.split(ids, np.cumsum(sizes)[:-1]), symbols, strict=True):
        assert own.tolist() == words.by_heap(s.tolist())


def test_decoding_any_ids(words):
    rng = random.Random(1)
    lists = [[rng.choice([0, 1, 2, 259, 300, 29871, *range(3, 259)]) for _ in range(rng.randrange(12))] for _ in range(400)]
    back = words.decode(np.concatenate([np.array(x, np.int64) for x in lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    for got, x in zip(back, lists, strict=True):
        assert got == words.library.decode(x), x
    with pytest.raises(ValueError):
        words.decode(np.array([32_000]), np.array([0, 1]))


def test_a_wrong_merge_is_found(words, monkeypatch):
    rng = random.Random(6)
    chunks = pa.array(["▁" + "".join(rng.choice("abcdetion") for _ in range(12)) for _ in range(50)])
    words.fresh(chunks)
    monkeypatch.setattr(words, "rank", words.rank.max() - words.rank)
    with pytest.raises(RuntimeError, match="differ"):
        words.fresh(chunks)


def test_round_trip_on_spark(spark, odd_docs, no_docs):
    model = piece_bpe.model_file()
    for docs in (odd_docs, odd_docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")), read(spark, SF, "documents")):
        assert piece_bpe.differing(docs, model).count() == 0
    coded = piece_bpe.encoded(odd_docs, model)
    back = [(r["doc_id"], r["text"]) for r in piece_bpe.decoded(coded, model).collect()]
    assert Counter(back) == Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert piece_bpe.encoded(no_docs, model).count() == 0
    assert piece_bpe.decoded(coded.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), model).filter("text <> ''").count() == 0


def test_digests_of_coding(spark, words):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").collect()}
    rows = piece_bpe.op13_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = words.library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(words.library.decode(ids).encode()).hexdigest()


# -- links --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return token_links.Aligner(token_links.tokenizer_file(), piece_bpe.model_file())


def plain_links(both, text):
    """Counts, digest and links of one text, token by token from the libraries."""
    nothing = (0, 0, 0, 0, ""), []
    if not text:
        return nothing
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.library.encode(text)
    table = token_links.byte_of_sign()
    a_bytes = [bytes(table[c] for c in both.a.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(both.b.library.id_to_piece, b)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return nothing
    groups, links, i, j, x, y, k, m = [], [], 0, 0, 0, 0, 0, 0
    while i < len(a):  # forward until both ends meet
        x, i = x + len(a_bytes[i]), i + 1
        while y < x:
            y, j = y + len(b_bytes[j]), j + 1
        if x == y:
            groups.append(",".join(map(str, a[k:i])) + "|" + ",".join(map(str, b[m:j])))
            links += [(p, q) for p in a[k:i] for q in b[m:j]]
            k, m = i, j
    return (len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def test_alignment_of_odd_texts(both):
    texts = signs(7)
    sums, shas, keys, times, doc = both.align(pa.array(texts))
    got = [Counter() for _ in texts]
    for key, n, d in zip(keys.tolist(), times.tolist(), doc.tolist(), strict=True):
        got[d][divmod(key, both.n_b)] += n
    for i, t in enumerate(texts):
        want, links = plain_links(both, t)
        assert (*sums[i].tolist(), shas[i]) == want, t[:60]
        assert got[i] == Counter(links), t[:60]


def test_long_groups_are_folded(both, monkeypatch):
    rng = random.Random(2)
    n_a, n_b = np.array([3, 40, 2, 90]), np.array([2, 50, 5, 80])
    a, b = (np.array([rng.randrange(20) for _ in range(n.sum())]) for n in (n_a, n_b))
    want = Counter()
    for g in range(4):
        for x in a[n_a[:g].sum() : n_a[: g + 1].sum()]:
            for y in b[n_b[:g].sum() : n_b[: g + 1].sum()]:
                want[int(x) * both.n_b + int(y)] += 1
    for fold, at_once in ((4096, 1 << 22), (100, 1 << 22), (1, 1 << 22), (4096, 7), (2000, 64)):
        monkeypatch.setattr(token_links, "FOLD", fold)
        monkeypatch.setattr(token_links, "AT_ONCE", at_once)
        keys, times, sizes = both.links(a, b, n_a, n_b)
        got = Counter()
        for k, n in zip(keys.tolist(), times.tolist(), strict=True):
            got[k] += n
        assert got == want and sizes.sum() == len(keys)


def test_bitmaps():
    rng = np.random.default_rng(1)
    for among in (1, 9, 1000, 65_536):
        for share in (0.0, 0.01, 0.5, 1.0):
            slots = np.flatnonzero(rng.random(among) < share)
            held = token_links.bitmap(slots, among)
            assert token_links.slots_of(held).tolist() == slots.tolist() and token_links.popcount(held) == len(slots)
            assert len(held) <= among / 8 + 2


def plain_table(both, rows):
    each = [plain_links(both, t) for _, t in rows]
    count = Counter(p for _, links in each for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return Counter((i, *meta[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), meta[4]) for (i, _), (meta, links) in zip(rows, each, strict=True))


def test_links_of_whole_tables(spark, both, odd_docs, no_docs):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    files = token_links.tokenizer_file(), piece_bpe.model_file()
    made = spark.createDataFrame(list(enumerate(signs(9, 150))), "doc_id long, text string").repartition(7)
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("block", "slot", "a", "b", "docs", "held")})
    for docs in (made, clash, read(spark, SF, "documents").repartition(5)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert Counter(tuple(r[c] for c in columns) for r in token_links.token_links(docs, *files).collect()) == plain_table(both, rows)
    assert token_links.token_links(no_docs, *files).count() == 0


# -- negatives ----------------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=100):
    """rows: (vec_id, label, vector). Each row is a row of its own."""
    out = Counter()
    usable = [(i, v, l, np.floor(256 * np.array(x, float))) for i, (v, l, x) in enumerate(rows) if v is not None and l is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max((len(u[3]) for u in usable), default=0)
    if not usable:
        return out
    vec = np.array([np.pad(u[3], (0, width - len(u[3]))) for u in usable])
    ids, labels = np.array([u[1] for u in usable]), np.array([u[2] for u in usable])
    for k, (_, anchor, label, _) in enumerate(usable):
        if anchor % every:
            continue
        score = (vec @ vec[k]).astype(np.int64)
        order = np.lexsort((ids, -score))
        positives = [i for i in order if labels[i] == label and i != k][:5]
        others = [i for i in order if labels[i] != label]
        for p in positives:
            window = [i for i in others if 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out.update((anchor, int(ids[p]), n + 1, int(ids[i]), int(score[p]), int(score[i])) for n, i in enumerate(window))
    return out


def mined(spark, rows, every=100):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"i": F.lit(1), "row": F.lit(2), "vec": F.lit("x")}).repartition(5)
    found = hard_negatives.hard_negatives(hard_negatives.usable(df, F.col("label")), F.col("vec_id") % every == 0)
    return Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_of_the_table(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()]
    got = Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard_negatives.op11_hard_negatives(spark, SF).collect())
    assert got == plain_negatives(rows) and got


def test_negatives_of_clusters_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 10))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(12)] + 0.05 * rng.normal(size=10)).astype(np.float32).tolist()) for i in range(6000)]
    rows += [(6000 + i, int(i % 3), rows[0][2]) for i in range(1500)]  # one vector in many rows
    rows += [(7001, 1, None), (7002, None, rows[1][2]), (None, 1, rows[1][2]), (7003, 1, [1.0, None]), (7004, 2, [float("nan")] * 10), (7005, 2, [float("inf")] * 10), (7006, 2, []), (7007, 3, [0.5]), (7100, 3, [0.5])]
    rows += [(300, 2, rows[300][2]), (7100, 3, [0.5])]  # a repeated id, a repeated row
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_few_rows(spark):
    assert not mined(spark, [(None, None, None)])
    assert not mined(spark, [(100, 1, [1.0, 2.0])])
    some = [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.9]), (4, 2, [-1.0])]
    assert mined(spark, some) == plain_negatives(some)
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(100, 1, [3e7, 1.0]), (1, 1, [3e7, 1.0])])


def test_cells_come_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(2)
    vec = np.floor(256 * rng.normal(size=(500, 8)))
    books = tuple(hard_negatives.fitted(h, 6) for h in (vec[:, :4], vec[:, 4:]))
    codes = [hard_negatives.nearest(h, b) for h, b in zip((vec[:, :4], vec[:, 4:]), books, strict=True)]
    radii = tuple(np.array([max(np.sqrt(((h - b[c]) ** 2).sum(1))[own == c], default=0.0) for c in range(6)]) for h, b, own in zip((vec[:, :4], vec[:, 4:]), books, codes, strict=True))
    counts = np.zeros((6, 6), np.int64)
    np.add.at(counts, tuple(codes), 1)
    index = hard_negatives.Index(8, "<i4", books, radii, counts)
    for q in vec[:20]:
        seen = list(index.visit(q))
        assert [c[0] for c in seen] == sorted((c[0] for c in seen), reverse=True) and len({c[2:] for c in seen}) == len(seen) == (counts > 0).sum()
        for upper, lower, i, j in seen:
            scores = vec[(codes[0] == i) & (codes[1] == j)] @ q
            assert lower <= scores.min() and scores.max() <= upper
