"""Quality classifier: a byte-level convolutional network in numpy.

A text is read in chunks of CHUNK + WIDTH - 1 bytes that overlap and cover it to its end. Each byte has a learned
embedding, FILTERS learned filters of WIDTH bytes slide over every position of a chunk, each filter's largest answer
in the chunk is kept, and a small hidden layer over these and the chunk's filled share (few answers mean monotony in a
full chunk, nothing in a short one) makes the chunk's logit. A document's logit is the mean over its chunks.

Fitting uses at most SAMPLE labelled documents of either class (those with the smallest hash of their id) and at most
CHUNKS_FIT chunks of each; scoring reads every byte of every text. Only text and labels.quality enter the model.

Null and empty texts are scored as one chunk of padding. Without labels of both classes every score is 0.5.
Repeated rows get the same score. An empty table gives an empty result. Extra columns are passed through by `scored`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import PAD, Adam, chunk_bytes, chunk_rows, chunk_starts, held_out, raw, read, sampled_chunks, slices, small_batches, texts

CHUNK, WIDTH, EMBED, FILTERS, HIDDEN = 256, 5, 4, 16, 12
SAMPLE, CHUNKS_FIT, STEPS, BATCH = 1200, 8, 500, 128
SPAN = CHUNK + WIDTH - 1
#: Rows of chunks that go through the filters at once.
BLOCK = 192


def fresh(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed).normal
    w = {"embed": draw(0, 0.5, (PAD + 1, EMBED)), "conv": draw(0, 0.3, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS), "join": draw(0, 0.3, (FILTERS + 1, HIDDEN)), "shift": np.zeros(HIDDEN), "out": draw(0, 0.3, HIDDEN), "base": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def windows(w: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """(rows, CHUNK, WIDTH * EMBED): the embedded bytes under each place of the filters."""
    x = w["embed"][rows]
    view = np.lib.stride_tricks.as_strided(x, (len(rows), CHUNK, WIDTH * EMBED), (x.strides[0], x.strides[1], x.strides[2]))
    return np.ascontiguousarray(view)


def pooled(top: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Largest answers after the rectifier, and the share of the chunk that is text."""
    filled = (rows != PAD).sum(axis=1, dtype=np.float32) / SPAN
    return np.concatenate([np.maximum(top, 0), np.sqrt(filled)[:, None]], axis=1)


def chunk_logits(w: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.float32)
    for i in range(0, len(rows), BLOCK):
        x = windows(w, rows[i : i + BLOCK])
        top = (x.reshape(-1, WIDTH * EMBED) @ w["conv"]).reshape(len(x), CHUNK, FILTERS).max(axis=1)
        hidden = np.tanh(pooled(top + w["bias"], rows[i : i + BLOCK]) @ w["join"] + w["shift"])
        out[i : i + BLOCK] = hidden @ w["out"] + w["base"][0]
    return out


def shortened(row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A part of a chunk that looks like a short text: it mostly begins and ends with a sentence."""
    stops = np.flatnonzero(row[:-2] == ord(".")) + 1
    begin = int(rng.choice(stops)) + 1 if len(stops) and rng.random() < 0.5 else 0
    size = int(np.exp(rng.uniform(np.log(5), np.log(SPAN))))
    inside = stops[(stops > begin + 2) & (stops <= begin + size)]
    end = int(inside[-1]) if len(inside) and rng.random() < 0.8 else begin + size
    out = np.full_like(row, PAD)
    part = row[begin:end]
    out[: len(part)] = part
    return out


def fit(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on batches with a quarter of label 0; half of the chunks are cut short, as short texts are."""
    w, rng = fresh(seed), np.random.default_rng(seed)
    adam = Adam(w, 0.01)
    of = [np.flatnonzero(labels == c) for c in (0, 1)]
    for step in range(STEPS):
        adam.rate = 0.01 if step < STEPS * 0.6 else 0.002
        pick = np.concatenate([rng.choice(of[0], BATCH // 4), rng.choice(of[1], BATCH - BATCH // 4)])
        seen_rows = np.stack([shortened(r, rng) if rng.random() < 0.5 else r for r in rows[pick]])
        x, y = windows(w, seen_rows), labels[pick]
        answers = (x.reshape(-1, WIDTH * EMBED) @ w["conv"]).reshape(len(pick), CHUNK, FILTERS)
        where = answers.argmax(axis=1)
        pre = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0] + w["bias"]
        act = pooled(pre, seen_rows)
        hidden = np.tanh(act @ w["join"] + w["shift"])
        d = ((1 / (1 + np.exp(-(hidden @ w["out"] + w["base"][0])))) - y).astype(np.float32) / len(pick)
        d_hidden = d[:, None] * w["out"] * (1 - hidden * hidden)
        d_pre = (d_hidden @ w["join"].T)[:, :FILTERS] * (pre > 0)
        seen = np.take_along_axis(x, where[:, :, None], axis=1)  # (batch, FILTERS, WIDTH * EMBED)
        d_seen = d_pre[:, :, None] * w["conv"].T
        d_embed = np.zeros_like(w["embed"])
        at = where[:, :, None] + np.arange(WIDTH)
        symbols = seen_rows[np.arange(len(pick))[:, None, None], at]
        np.add.at(d_embed, symbols, d_seen.reshape(*symbols.shape, EMBED))
        adam.step({"embed": d_embed, "conv": np.einsum("bf,bfw->wf", d_pre, seen), "bias": d_pre.sum(0), "join": act.T @ d_hidden, "shift": d_hidden.sum(0), "out": hidden.T @ d, "base": d.sum(keepdims=True)})
    return w


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The model fitted to labelled rows whose id isn't held out; None without both classes."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select("doc_id", "quality")
    both = [known.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(both[0].unionByName(both[1])), "doc_id")  # 2 * sample ids at most
    found = sampled_chunks(rows, "quality", "int", SPAN, CHUNKS_FIT).toArrow()
    y = np.asarray(found["value"])
    if len(np.unique(y)) < 2:
        return None
    chunks = found["chunk"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (chunks[i], y[i]))  # the same model whatever the order of arrival
    return fit(chunk_rows([chunks[i] for i in order], SPAN), y[order].astype(np.float32))


def score_texts(w: dict[str, np.ndarray] | None, column: pa.Array) -> np.ndarray:
    """The probability of label 1 for each text, from all of its bytes."""
    if w is None:
        return np.full(len(column), 0.5)
    data, offsets = raw(column)
    counts, starts = chunk_starts(np.diff(offsets), SPAN, CHUNK, flush=True)
    begin = np.repeat(offsets[:-1], counts) + starts
    end, logits = np.repeat(offsets[1:], counts), np.empty(len(begin), np.float64)
    for i in range(0, len(begin), 16 * BLOCK):
        logits[i : i + 16 * BLOCK] = chunk_logits(w, chunk_bytes(data, begin[i : i + 16 * BLOCK], end[i : i + 16 * BLOCK], SPAN))
    means = np.add.reduceat(logits, np.cumsum(counts) - counts) / counts
    return 1 / (1 + np.exp(-np.clip(means, -60, 60)))


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str = "score", at_least: float | None = None, keep_text: bool = True) -> DataFrame:
    """docs with the score as one more column; with at_least, only rows that reach it; without keep_text, no text."""
    place = docs.columns.index("text")
    out_fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = pa.array(score_texts(model, texts(batch.column(place))), pa.float64())
            out = pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if keep_text or i != place), score], [*(f.name for f in out_fields), name])
            yield out if at_least is None else out.filter(pc.greater_equal(score, at_least))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_fields)
    return small_batches(docs).mapInArrow(run, f"{schema}, `{name}` double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs.select("doc_id", "text"), learned(docs, labels), keep_text=False)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be of low quality; all columns stay."""
    return scored(docs, learned(docs, labels), "__fr_score", at_least=0.5).drop("__fr_score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
