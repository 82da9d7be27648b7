"""MinHash near-dedup: BagMinHash signatures, banding, exact check of multiset overlap, connected classes.

Each text is a bag of five-word shingles (lower case, white space between words); a shingle that occurs n times has
weight n. Weights are discretised to whole numbers. For each shingle, hierarchical Poisson processes run over the weight
axis: one process for [0, 1) and one for each octave [2^(j-1), 2^j); a point of an octave's process goes down to one
unit of it, and counts for all texts whose weight reaches beyond that unit. Each point falls into one of SIZE
components, and a component keeps its earliest point. Two texts agree in a component with just the probability of their
weighted Jaccard similarity. Points are only made up to a time by which all components are likely filled; texts with an
empty component go on with twice the time, so that signatures stay exact.

Exact copies are folded first. The texts left are banded (ROWS components a band), and in each bucket members are
compared with one member, the hub, that changes from round to round: work is linear in the bucket. A pair passes if the
multiset Jaccard similarity of its whole texts is at least THRESHOLD. Pairs already in one class need no check. After
the first round buckets are parted by size, and shingles that no other open member has bound what a member can share; the
second hub is a small member with few of them, which is close to what the copies were made from or have in common, or
the best such member that it meets in any bucket.

Members that still differ in class are then joined exactly, without making all pairs of a bucket. Each is written as its
signed difference from its hub h: shingles added and shingles missing, each as often as it is (d of them). Similarity
THRESHOLD of x and y means that d(x) + d(y) less twice what their differences share is at most C * (n(x) + n(y)), with
C = (1 - THRESHOLD) / (1 + THRESHOLD). If x is no link of h, d(x) > C * (n(x) + n(h)), so the two must share more than
(d(y) + C * (n(h) - n(y))) / 2 of y's difference: edits, not the common body. Differences that one class alone has are
left out, as are those that no such x has, the others ordered with the rarest first, and only pairs that share one among the first few (all but what must
be shared, and one) with enough behind it are checked. No link between members of a bucket is lost. Signatures that
agree in so few components that similarity THRESHOLD is 5 standard deviations off spare the check of the texts.

Texts of any length are read whole, a batch of about SLICE_BYTES at a time or one longer text. Null and empty texts, and
those without a word, are copies of each other. Rows that share a doc_id share a class. A
null doc_id has no class (null). An empty table gives an empty result. Extra columns are passed through by
`one_of_each` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frontrank.llm.common import SHINGLE, bag, bag_jaccard, mixed, read, slices, small_batches, texts, without_ids, word_hashes, written

SIZE, ROWS = 125, 5
BANDS = SIZE // ROWS
THRESHOLD, ROUNDS = 0.8, 2
#: Two bags of n and m shingles reach THRESHOLD if they differ in at most C * (n + m).
C = (1 - THRESHOLD) / (1 + THRESHOLD)
#: Texts that one copy of a hub's text is joined to.
PART = 1000
#: Agreeing components below which similarity THRESHOLD is 5 standard deviations off.
LEAST = int(SIZE * (THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / SIZE) ** 0.5))
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)


def first_points(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, patience: float = 4.0) -> np.ndarray:
    """(n, SIZE): the time of the earliest point in each component of each bag; owner says whose a shingle is."""
    totals = np.bincount(owner, weights, n)
    until = SIZE / np.maximum(totals, 1) * (np.log(SIZE) + patience)
    out = np.full(n * SIZE, np.inf)
    octave = np.zeros(len(hashes), np.int64)
    heavy = np.flatnonzero(weights > 1)
    more = [heavy]
    while len(heavy):  # octave j serves weights over 2^(j-1)
        heavy = heavy[weights[heavy] > (1 << (len(more)))]
        more.append(heavy)
    which = np.concatenate([np.arange(len(hashes)), *more])
    octave = np.concatenate([octave, *(np.full(len(x), j + 1) for j, x in enumerate(more))])
    low = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    rate = np.maximum(low, 1).astype(np.float64)
    seed = mixed(hashes[which] + _A * (octave + 1).astype(np.uint64))
    own, weight, time, nth = owner[which], weights[which], np.zeros(len(which)), 0
    while len(own):
        nth += 1
        draw = mixed(seed + np.uint64(nth * int(_B) % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        stay = np.flatnonzero(time <= until[own])
        own, weight, time, seed, rate, low = own[stay], weight[stay], time[stay], seed[stay], rate[stay], low[stay]
        draw = mixed(draw[stay] ^ _A)
        component = ((draw >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        unit = low + (draw.astype(np.int64) & np.maximum(low - 1, 0))
        hit = unit < weight
        np.minimum.at(out, own[hit] * SIZE + component[hit], time[hit])
    out = out.reshape(n, SIZE)
    again = np.isinf(out).any(axis=1) & (totals > 0)
    if again.any():
        number, mine = np.cumsum(again) - 1, again[owner]
        out[again] = first_points(number[owner[mine]], hashes[mine], weights[mine], int(again.sum()), 2 * patience + np.log(SIZE))
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(bags, SIZE) 32-bit signature components."""
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    times = first_points(owner, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags))
    return (mixed(np.ascontiguousarray(times).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_keys(found: np.ndarray) -> np.ndarray:
    """(bags, BANDS) 64-bit bucket keys."""
    parts = found.astype(np.uint64).reshape(len(found), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key * _B + parts[:, :, i])
    return key


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, number of shingles, signature and bucket keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, limit=2 << 20):
            column = texts(batch.column(1))
            words, offsets = word_hashes(column)
            bags = [bag(words[a:b], SHINGLE) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            found = signatures(bags)
            keys = band_keys(found)
            digest = [xxhash.xxh3_128_digest(t) if len(b[0]) else b"" for t, b in zip(column.to_pylist(), bags, strict=True)]
            total = np.array([int(b[1].sum()) for b in bags])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(total, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))],
                ["doc_id", "digest", "shingles", "signature", "keys"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, shingles long, signature binary, keys array<long>")


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures and numbers of shingles don't rule out similarity THRESHOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SIZE) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= LEAST))

    def one(name: str, size: str, key: str) -> DataFrame:
        return reps.select(F.col("doc_id").alias(key), F.col("signature").alias(name), F.col("shingles").alias(size))

    both = pairs.join(one("x", "m", "b"), "b").join(one("y", "n", "a"), "a")
    near = both.filter(F.least("m", "n") >= F.greatest("m", "n") * (THRESHOLD - 1e-9))
    return near.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, ta, tb: pairs with their texts. A text a of many pairs is copied for each PART of them, so that no task gets them all."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    n = ids.count()
    own = docs.select("doc_id", "text").join(F.broadcast(ids) if n <= 1_000_000 else ids, "doc_id", "left_semi")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")
    heads = own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).join(parts, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(heads, ["a", "part"]).select("a", "b", "ta", "tb")


def _by_head(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of with_texts, and for each of their rows the bags of ta and tb. Rows come by ta, whose bag is made once."""
    hub: tuple | None = None
    for batch in slices(slices(batches, "ta"), "tb"):
        words, offsets = word_hashes(texts(batch.column(3)))
        bags, heads = [], batch.column(2)
        for i, a in enumerate(batch.column(0).to_pylist()):
            head = heads[i].as_py() or ""
            if hub is None or hub[0] != a or hub[1] != head:
                hub = (a, head, bag(word_hashes(pa.array([head]))[0]))
            bags.append((hub[2], bag(words[offsets[i] : offsets[i + 1]])))
        yield batch, bags


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts' multiset Jaccard similarity is at least THRESHOLD, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bags in _by_head(batches):
            found = pa.array([bag_jaccard(x, y) for x, y in bags], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["a", "b", "similarity"]).filter(pc.greater_equal(found, THRESHOLD - 1e-9))

    return with_texts(pairs, docs).mapInArrow(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def difference(hub: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle that own has more often than hub or less often (one for either case), and how much."""
    _, i, j = np.intersect1d(hub[0], own[0], assume_unique=True, return_indices=True)
    less, more = hub[1].astype(np.int64), own[1].astype(np.int64)
    shared = np.minimum(less[i], more[j])
    less[i] -= shared
    more[j] -= shared
    return np.concatenate([mixed(hub[0][less > 0] + _A), mixed(own[0][more > 0] + _B)]), np.concatenate([less[less > 0], more[more > 0]])


def differences(met: DataFrame, docs: DataFrame) -> DataFrame:
    """For pairs (h, x) of a hub and a member: h, ht, x, xt, n and m (shingles of x and of h), d, its elements and their weights.

    ht and xt are hashes of the texts: a doc_id may stand for several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, bags in _by_head(batches):
            found = [difference(x, y) for x, y in bags]
            ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            elements = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]).view(np.int64))) for i in (0, 1)]
            hashes = [pa.array([xxhash.xxh3_64_intdigest(t or "") >> 1 for t in batch.column(i).to_pylist()], pa.int64()) for i in (2, 3)]
            counts = [pa.array([int(b[i][1].sum()) for b in bags], pa.int64()) for i in (1, 0)]
            total = pa.array([int(f[1].sum()) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes[0], batch.column(1), hashes[1], *counts, total, *elements], ["h", "ht", "x", "xt", "n", "m", "d", "elements", "weights"])

    pairs = met.select(F.col("h").alias("a"), F.col("x").alias("b"))
    return with_texts(pairs, docs).mapInArrow(run, "h long, ht long, x long, xt long, n long, m long, d long, elements array<long>, weights array<long>").dropDuplicates(["h", "ht", "x", "xt"])


def candidates(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different class, among them all of similarity THRESHOLD that have a hub in common. members: (h, x, class)."""
    found = written(differences(members.select("h", "x"), docs).join(members, ["h", "x"]), "differences")
    of = ["h", "ht", "x", "xt"]
    far = F.col("d") > C * (F.col("n") + F.col("m")) + 1e-9  # no link of the hub; one of a pair is
    flat = found.select(*of, "class", "n", "m", "d", far.alias("far"), F.explode(F.arrays_zip("elements", "weights")).alias("e"))
    flat = flat.withColumns({"e": F.col("e.elements"), "w": F.col("e.weights")})
    often = flat.groupBy("h", "ht", "e").agg(F.count("*").alias("often"), F.min("class").alias("low"), F.max("class").alias("high"), F.bool_or("far").alias("some")).filter("low < high AND some").select("h", "ht", "e", "often")
    known = flat.join(often, ["h", "ht", "e"])
    # What is left of a difference from each element on, rarest first: two can't share more than that behind the first that they share.
    left = F.sum("w").over(Window.partitionBy(*of).orderBy(F.desc("often"), F.desc("e")).rowsBetween(Window.unboundedPreceding, 0))
    must = F.floor((F.col("d") + C * (F.col("m") - F.col("n"))) / 2 + 1e-9)  # to be shared with one that is far: more than this
    some = F.greatest(F.lit(1), F.ceil((F.col("d") - C * (F.col("n") + F.col("m"))) / 2 - 1e-9))  # with one that isn't: at least this
    ends = known.select(*of, "class", "n", "d", "e", "far", left.alias("left"), (must + 1).alias("must"), some.alias("some"))
    ends = written(ends.filter("left >= must OR far AND left >= some"), "prefixes")

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("h", "ht", "e", *[F.col(c).alias(f"{c}{name}") for c in ("x", "n", "d", "left", "class")])

    enough = f"classa <> classb AND least(lefta, leftb) >= (da + db - {C!r} * (na + nb)) / 2 - 1e-9"
    both_far = side("a", ends.filter("far AND left >= must")).join(side("b", ends.filter("far AND left >= must")), ["h", "ht", "e"]).filter(f"xa < xb AND {enough}")
    one_far = side("a", ends.filter("far AND left >= some")).join(side("b", ends.filter("NOT far AND left >= must")), ["h", "ht", "e"]).filter(enough)
    return both_far.union(one_far).select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b")).distinct()


def lone_shingles(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, alone): for each of these documents, how many of its shingles none of the others has; 0 for repeated ids.

    Two of them can share no more than what is left in either, which bounds their similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            words, offsets = word_hashes(texts(batch.column(1)))
            bags = [bag(words[a:b], SHINGLE) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            row = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
            hashes, counts = (np.concatenate([b[i] for b in bags]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["doc_id", "shingle", "n"])

    n = ids.count()
    own = docs.select("doc_id", "text").join(F.broadcast(ids) if n <= 1_000_000 else ids, "doc_id", "left_semi")
    repeated = own.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")  # maybe of different texts: no bound
    places = own.mapInArrow(run, "doc_id long, shingle long, n long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    alone = places.filter("c = 1").groupBy("doc_id").agg(F.sum("n").alias("alone"))
    return ids.join(alone.join(repeated, "doc_id", "left_anti"), "doc_id", "left").select("doc_id", F.coalesce("alone", F.lit(0)).alias("alone"))


def components(edges: DataFrame) -> DataFrame:
    """(node, class): each node's smallest reachable node. edges: (a, b). Large-star and small-star rounds."""
    current = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        current = written(small.filter("u > v").distinct(), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("class"))


def folded(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, class) after links (a, b) between nodes have joined some of them."""
    of = [classes.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")) for x in ("a", "b")]
    between = links.join(of[0], "a").join(of[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b")
    joined = components(between).select(F.col("node").alias("class"), F.col("class").alias("to"))
    return written(classes.join(joined, "class", "left").select("node", F.coalesce("to", "class").alias("class")), "classes")


def by_size(members: DataFrame) -> DataFrame:
    """Buckets parted by numbers of shingles: two members that can be linked share one of the parts."""
    step = -log(THRESHOLD) * (1 + 1e-6)
    part = F.floor(F.log("shingles") / step).cast("int")
    return members.withColumn("part", F.explode(F.array(part, part - 1))).withColumn("key", F.xxhash64("key", "part"))


def _open(members: DataFrame) -> DataFrame:
    """Buckets (key) whose members are of more than one class."""
    return members.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x < y").select("key")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), copy_of (smallest doc_id of the same text) for each row."""
    rows = written(signed(docs), "signatures")
    named = rows.filter(F.col("doc_id").isNotNull())
    copies = written(named.groupBy("digest").agg(F.min("doc_id").alias("copy_of")), "copies")
    reps = written(named.filter("shingles > 0").join(copies, "digest").filter("doc_id = copy_of").drop("digest", "copy_of"), "texts")
    bands = reps.select("doc_id", "shingles", F.explode("keys").alias("key")).distinct()
    shared = written(bands.join(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key"), "buckets")
    classes = written(copies.select(F.col("copy_of").alias("node"), F.col("copy_of").alias("class")).distinct(), "classes")
    done: DataFrame | None = None
    # Once pairs with the first hubs are known, shingles that no other open member has bound what a pair may share.
    within = "least(sa, sb) >= {t} * (na + nb - least(sa, sb))".format(t=THRESHOLD - 1e-9)
    for turn in range(ROUNDS + 1):
        members = shared.join(classes.select(F.col("node").alias("doc_id"), "class"), "doc_id")
        if turn:  # only buckets in which classes still differ, parted by size
            members = by_size(members.join(_open(members), "key"))
            if turn == 1:
                alone = written(lone_shingles(docs, written(members.select("doc_id").distinct(), "open")), "alone")
            able = members.join(alone, "doc_id").withColumn("s", F.col("shingles") - F.col("alone")).filter(F.col("s") >= F.col("shingles") * (THRESHOLD - 1e-9))
            least = able.groupBy("key").agg(F.min("shingles").alias("least"))  # no member can share more than s, nor be met by a smaller one
            able = able.join(least, "key").filter(F.col("s") * (1 + THRESHOLD) >= (F.col("shingles") + F.col("least")) * (THRESHOLD - 1e-9)).drop("least")
            members = able.join(_open(able), "key")
        else:
            members = members.withColumns({"s": F.col("shingles"), "part": F.lit(0)})
        if turn < ROUNDS:
            share = 1 - F.col("s") / F.col("shingles")
            order = F.struct(F.floor(share * 25).alias("few"), F.floor(F.log("shingles") * 20).alias("size"), share.alias("alone"), "doc_id", "class", "s", "shingles")
            hubs = members.groupBy("key", "part").agg(F.min(order).alias("hub"))
            if turn == ROUNDS - 1:  # the hub of a bucket gives way to the best hub that it meets in another, so that buckets of one text share it
                hubs = written(hubs, "own")
                met = members.select("key", "doc_id").join(hubs, "key").groupBy("doc_id", "part").agg(F.min("hub").alias("best"))
                hubs = hubs.join(met.withColumnRenamed("part", "own"), (F.col("hub.doc_id") == F.col("doc_id")) & (F.col("part") == F.col("own"))).select("key", F.col("best").alias("hub"))
            hubs = written(hubs.select("key", F.col("hub.doc_id").alias("h"), F.col("hub.class").alias("hc"), F.col("hub.s").alias("sb"), F.col("hub.shingles").alias("nb")), "hubs")
            met = members.join(hubs, "key").withColumnsRenamed({"s": "sa", "shingles": "na"}).filter("class <> hc").filter(within)
            pairs = met.select(F.least("h", "doc_id").alias("a"), F.greatest("h", "doc_id").alias("b")).distinct()
        else:
            grouped = members.join(hubs.select("key", "h"), "key").filter("doc_id <> h").select("h", F.col("doc_id").alias("x"), "class").distinct()
            pairs = candidates(written(grouped, "members"), docs)
        fresh = written(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs, "pairs")
        if fresh.isEmpty():
            continue
        done = done.union(fresh) if done is not None else fresh
        close = written(alike(fresh, reps), "close")
        links = written(verified(close, docs), "links")
        if not links.isEmpty():
            classes = folded(classes, links)
    found = rows.select("doc_id", "digest").join(copies, "digest", "left").join(classes.select(F.col("node").alias("copy_of"), F.col("class").alias("class_id")), "copy_of", "left")
    named_only = F.col("doc_id").isNotNull()
    return found.select("doc_id", F.when(named_only, F.col("class_id")).alias("class_id"), F.when(named_only, F.col("copy_of")).alias("copy_of"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with only the smallest doc_id of each class; all columns stay."""
    drop = written(near_dedup(docs).filter("doc_id <> class_id").select("doc_id").distinct(), "drop")
    return without_ids(docs, drop, drop.count(), ["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
