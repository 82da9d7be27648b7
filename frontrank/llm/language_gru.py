"""Language ID: a bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

A text is read in chunks of SPAN bytes, to its end. One network reads each chunk forwards, one backwards; together
they give every byte position a probability for each language. A document's probabilities are the mean over all of its
positions, its language is the likeliest, its score that mean.

Fitting uses about SAMPLE documents of each language (those with the smallest hash of their id, so it doesn't depend
on the order of rows) and at most CHUNKS_FIT chunks of each; prediction reads every byte. Only text and lang of rows
that aren't held out enter the model.

A null text, or one without a letter, is `und` with score 0. Without any labelled row every document is `und`.
Of equally likely languages the first by name wins. Texts of any length are read whole. Repeated rows get the same answer. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import PAD, Adam, chunk_bytes, chunk_rows, chunk_starts, held_out, raw, read, sampled_chunks, slices, small_batches, texts

SPAN, HIDDEN = 64, 8
SAMPLE, CHUNKS_FIT, STEPS, BATCH = 400, 6, 250, 128
#: Chunks that go through the network at once.
BLOCK = 2048
UNKNOWN = "und"


def fresh(n_langs: int, seed: int) -> dict[str, np.ndarray]:
    draw, h = np.random.default_rng(seed).normal, HIDDEN
    w = {"out": draw(0, 0.3, (2 * h, n_langs)), "base": np.zeros(n_langs)}
    for side in "fb":
        w |= {f"{side}_in": draw(0, 0.3, (PAD + 1, 3 * h)), f"{side}_rec": draw(0, 0.3, (h, 3 * h))}
    return {k: v.astype(np.float32) for k, v in w.items()}


def one_way(w: dict[str, np.ndarray], side: str, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States after each symbol. x: (SPAN, rows); the backward side reads it from its end. Padding leaves a zero state.

    The columns of the input table and of the recurrent weights are update gate, reset gate, candidate.
    """
    h, table, rec = HIDDEN, w[f"{side}_in"], w[f"{side}_rec"]
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    states = np.empty((*x.shape, h), np.float32)
    state = np.zeros((x.shape[1], h), np.float32)
    padded = (x == PAD).any(axis=1)
    for t in steps:
        given, back = table[x[t]], state @ rec
        gates = given[:, : 2 * h] + back[:, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :h], gates[:, h:]
        candidate = np.tanh(given[:, 2 * h :] + r * back[:, 2 * h :])
        if keep is not None:
            keep[t] = (state, z, r, candidate, back[:, 2 * h :])
        state = candidate + z * (state - candidate)
        if padded[t]:
            state = state * (x[t] != PAD)[:, None]
        states[t] = state
    return states


def position_probabilities(w: dict[str, np.ndarray], x: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    logits = forward.reshape(-1, HIDDEN) @ w["out"][:HIDDEN] + backward.reshape(-1, HIDDEN) @ w["out"][HIDDEN:] + w["base"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(*x.shape, -1)


def through_time(w: dict[str, np.ndarray], side: str, x: np.ndarray, kept: dict, d_states: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one direction's weights, from the last step read to the first."""
    h, rec = HIDDEN, w[f"{side}_rec"]
    steps = range(len(x) - 1, -1, -1) if side == "f" else range(len(x))
    d_given, d_rec = np.empty((*x.shape, 3 * h), np.float32), np.zeros_like(rec)
    carried = np.zeros((x.shape[1], h), np.float32)
    for t in steps:
        before, z, r, candidate, back = kept[t]
        d = (carried + d_states[t]) * (x[t] != PAD)[:, None]
        d_cand = d * (1 - z) * (1 - candidate * candidate)
        d_z = d * (before - candidate) * z * (1 - z)
        d_r = d_cand * back * r * (1 - r)
        d_given[t] = np.concatenate([d_z, d_r, d_cand], axis=1)
        d_back = np.concatenate([d_z, d_r, d_cand * r], axis=1)
        d_rec += before.T @ d_back
        carried = d * z + d_back @ rec.T
    flat, symbols = d_given.reshape(-1, 3 * h), x.reshape(-1)
    table = np.stack([np.bincount(symbols, flat[:, j], PAD + 1) for j in range(3 * h)], axis=1)
    return {f"{side}_in": table.astype(np.float32), f"{side}_rec": d_rec}


def fit(rows: np.ndarray, labels: np.ndarray, n_langs: int, steps: int = STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    w, rng = fresh(n_langs, seed), np.random.default_rng(seed)
    adam, of = Adam(w, 0.02), [np.flatnonzero(labels == c) for c in range(n_langs)]
    for step in range(steps):
        adam.rate = 0.02 if step < steps * 0.7 else 0.004
        pick = np.concatenate([rng.choice(c, max(1, BATCH // n_langs)) for c in of])
        x, y = rows[pick].copy(), labels[pick]
        short = rng.random(len(pick)) < 0.3
        x[short[:, None] & (np.arange(SPAN) >= rng.integers(4, SPAN, len(pick))[:, None])] = PAD
        x = np.ascontiguousarray(x.T)
        kept: dict[str, dict] = {"f": {}, "b": {}}
        states = {side: one_way(w, side, x, kept[side]) for side in "fb"}
        d = position_probabilities(w, x, states["f"], states["b"])
        d[:, np.arange(len(y)), y] -= 1
        d *= (x != PAD)[:, :, None] / max(1, int((x != PAD).sum()))
        flat = d.reshape(-1, n_langs).astype(np.float32)
        both = np.concatenate([states[s].reshape(-1, HIDDEN) for s in "fb"], axis=1)
        grads = {"out": both.T @ flat, "base": flat.sum(0)}
        d_both = (flat @ w["out"].T).reshape(*x.shape, 2 * HIDDEN)
        for i, side in enumerate("fb"):
            grads |= through_time(w, side, x, kept[side], d_both[:, :, i * HIDDEN : (i + 1) * HIDDEN])
        adam.step(grads)
    return w


def learned(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """The languages, and the network fitted to rows whose id isn't held out; None without a labelled row."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2)).select("doc_id", "text", "lang")
    langs = {r[0]: r[1] for r in sorted(known.groupBy("lang").count().collect())}  # a row for each language
    if not langs:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in langs.items() for v in (k, min(1.0, sample / n))]), F.col("lang"))
    found = sampled_chunks(known.filter(place < share), "lang", "string", SPAN, CHUNKS_FIT).toArrow()
    names = sorted(set(found["value"].to_pylist()))
    pairs = sorted((c, names.index(v)) for c, v in zip(found["chunk"].to_pylist(), found["value"].to_pylist(), strict=True) if c)
    if not pairs:
        return None
    return names, fit(chunk_rows([c for c, _ in pairs], SPAN), np.array([v for _, v in pairs]), len(names))


def thirds(w: dict[str, np.ndarray], side: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Input table and recurrent weights of each gate on its own, so that every step works on whole arrays.

    Both gates' weights are halved, as sigmoid(x) = (tanh(x / 2) + 1) / 2.
    """
    h = HIDDEN
    return [(np.ascontiguousarray(w[f"{side}_in"][:, i * h : (i + 1) * h] * f), np.ascontiguousarray(w[f"{side}_rec"][:, i * h : (i + 1) * h] * f)) for i, f in enumerate(map(np.float32, (0.5, 0.5, 1)))]


def states_of(gates: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, backwards: bool) -> np.ndarray:
    """What one_way gives, without what only fitting needs."""
    (z_in, z_rec), (r_in, r_rec), (c_in, c_rec) = gates
    steps = range(len(x) - 1, -1, -1) if backwards else range(len(x))
    states = np.empty((*x.shape, HIDDEN), np.float32)
    state = np.zeros((x.shape[1], HIDDEN), np.float32)
    z, r, c, back = (np.empty_like(state) for _ in range(4))
    padded, half = (x == PAD).any(axis=1), np.float32(0.5)
    for t in steps:
        for gate, given, rec in ((z, z_in, z_rec), (r, r_in, r_rec)):
            np.take(given, x[t], axis=0, out=gate, mode="clip")
            np.matmul(state, rec, out=back)
            gate += back
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        np.take(c_in, x[t], axis=0, out=c, mode="clip")
        np.matmul(state, c_rec, out=back)
        back *= r
        c += back
        np.tanh(c, out=c)
        np.subtract(state, c, out=back)
        back *= z
        state = np.add(c, back, out=states[t])
        if padded[t]:
            state *= (x[t] != PAD)[:, None]
    return states


def text_probabilities(w: dict[str, np.ndarray], column: pa.Array, n_langs: int) -> np.ndarray:
    """(texts, languages): the mean of the probabilities of all positions."""
    data, offsets = raw(column)
    sizes = np.diff(offsets)
    counts, starts = chunk_starts(sizes, SPAN, SPAN, flush=False)
    begin, end = np.repeat(offsets[:-1], counts) + starts, np.repeat(offsets[1:], counts)
    sides, out = [thirds(w, "f"), thirds(w, "b")], np.ascontiguousarray(w["out"].T)
    sums = np.zeros((n_langs, len(begin)))
    for i in range(0, len(begin), BLOCK):
        x = np.ascontiguousarray(chunk_bytes(data, begin[i : i + BLOCK], end[i : i + BLOCK], SPAN).T).astype(np.intp)
        p = out[:, :HIDDEN] @ states_of(sides[0], x, False).reshape(-1, HIDDEN).T
        p += out[:, HIDDEN:] @ states_of(sides[1], x, True).reshape(-1, HIDDEN).T
        p += w["base"][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        p = p.reshape(n_langs, *x.shape)
        if (x[-1] == PAD).any():
            p *= x != PAD
        sums[:, i : i + BLOCK] = p.sum(axis=1)
    return np.add.reduceat(sums, np.cumsum(counts) - counts, axis=1).T / np.maximum(1, sizes)[:, None]


def predicted(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]] | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = texts(batch.column(1))
            spoken = np.asarray(pc.match_substring_regex(column, r"\p{L}"), bool)
            lang, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            if model and spoken.any():
                names, w = model
                p = text_probabilities(w, column.filter(pa.array(spoken)), len(names))
                lang[spoken], score[spoken] = np.array(names, object)[p.argmax(axis=1)], np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predicted(docs, learned(docs)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
