"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as a vector of its own (hashed) and the mean of its character n-grams' vectors, so that unseen words of a known build are told as well.
A text is scored window by window, all overlapping windows of the whole text, and by its worst window. Labels are of whole documents: training
first takes any window of a toxic document for toxic, later only the one that the network finds worst.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WINDOW, STRIDE = 48, 32  # words
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15  # hashed vectors
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 12, 8, 8
GRAMS = (3, 4, 5)  # bytes, with a sign at each end of the word
CHUNK_BYTES = 4 << 20  # of text that is scored at once
BATCH = 2048  # windows
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Every word's number, where each text's words begin (and the last end), and the different words."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = _WORD_BYTE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    offsets = np.concatenate((np.cumsum(inside)[starts] - 1, [int(inside.sum())])).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    coded = words.dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return coded.indices.to_numpy(), np.concatenate(([0], np.searchsorted(starts, ends))), coded.dictionary


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row, its n-grams' rows, and where these begin."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8, count=int(offsets[-1]))
    size = np.diff(offsets) + 2
    begin = np.cumsum(size) - size
    signs = np.ones(int(size.sum()) + max(GRAMS), dtype=np.uint64)  # 1 at both ends
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(of)) - begin[of]
    signs[: len(of)][(at > 0) & (at < size[of] - 1)] = data
    roll = np.zeros(len(of), dtype=np.uint64)
    rows, owner = [], []
    for n in range(1, max(GRAMS) + 1):
        roll = roll * np.uint64(0x100000001B3) + signs[n - 1 : n - 1 + len(of)]
        if n in GRAMS:
            ok = at + n <= size[of]
            mixed = roll[ok] ^ (roll[ok] >> np.uint64(23))
            rows.append(((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAM_ROWS)
            owner.append(of[ok])
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(size))
    whole = np.add.reduceat(signs[: len(of)] * (np.uint64(0x9E3779B97F4A7C15) ** (at % 61).astype(np.uint64) | np.uint64(1)), begin)
    return ((whole ^ (whole >> np.uint64(29))) % np.uint64(WORD_ROWS)).astype(np.int64), rows[order], np.concatenate(([0], np.cumsum(counts)))


def _windows(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and size of all windows: every ``STRIDE`` words, the last one at the text's end; a text without words has an empty one."""
    sizes = np.diff(begin)
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(k * STRIDE, np.maximum(sizes[doc] - WINDOW, 0))
    return doc, begin[doc] + first, np.minimum(sizes[doc], WINDOW)


def _matrix(ids: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Words of windows, one row a position; ``pad`` beyond a window's size."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    inside = np.arange(WINDOW)[:, None] < size[None, :]
    return np.where(inside, ids[np.minimum(at, len(ids) - 1)] if len(ids) else pad, pad)


def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    of = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": of(WORD_ROWS, WORD_DIM, scale=0.1), "gram": of(GRAM_ROWS, GRAM_DIM, scale=0.3), "x": of(d, 6 * h, scale=d**-0.5), "b": np.zeros(6 * h, np.float32),
        "u0": of(h, 3 * h, scale=h**-0.5), "u1": of(h, 3 * h, scale=h**-0.5), "a": of(2 * h, ATTENTION, scale=0.3), "v": of(ATTENTION, scale=0.3), "w": of(2 * h, scale=0.3), "c": np.full(1, -1.0, np.float32),
    }


def _inputs(m: dict, row: np.ndarray, grams: np.ndarray, begin: np.ndarray, keep: np.ndarray | float = 1.0) -> np.ndarray:
    """The vector of each word."""
    n = np.maximum(np.diff(begin), 1)[:, None]
    sums = np.add.reduceat(m["gram"][grams], begin[:-1]) if len(grams) else np.zeros((len(row), GRAM_DIM), np.float32)
    return np.concatenate([m["word"][row] * keep, sums / n], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


def _forward(m: dict, gates: np.ndarray, ids: np.ndarray, tape: list | None = None) -> np.ndarray:
    """The logit of each column of ``ids``, rows of ``gates`` of which the last stands for no word. ``tape`` gets what the way back needs."""
    t, n = ids.shape
    h3, inside = 3 * HIDDEN, ids < len(gates) - 1
    full = bool(inside.all())
    states = np.zeros((t, n, 2 * HIDDEN), dtype=np.float32)
    kept = []
    for side, u in enumerate((m["u0"], m["u1"])):
        own = np.ascontiguousarray(gates[:, side * h3 : (side + 1) * h3])
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        for i in range(t) if side == 0 else range(t - 1, -1, -1):
            x, g = own[ids[i]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = _tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if not full:
                new = np.where(inside[i][:, None], new, h)
            if tape is not None:
                kept.append((side, i, h, z, r, c, g[:, 2 * HIDDEN :]))
            h = new
            states[i, :, side * HIDDEN : (side + 1) * HIDDEN] = h
    s = _tanh(states.reshape(-1, 2 * HIDDEN) @ m["a"]).reshape(t, n, ATTENTION)
    e = np.where(inside, np.exp(s @ m["v"]), 0)  # |s v| is at most the sum of |v|
    p = e / np.maximum(e.sum(axis=0), 1e-30)
    pooled = np.einsum("tn,tnd->nd", p, states)
    if tape is not None:
        tape.extend((kept, states, s, p, pooled, inside))
    return pooled @ m["w"] + m["c"]


def _summed(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``n`` rows, each the sum of the ``rows`` that ``at`` names."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 0)))
        out[at[first]] = np.add.reduceat(rows[order], first)
    return out


def _backward(m: dict, gates: np.ndarray, ids: np.ndarray, tape: list, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the network's own matrices, and of ``gates``."""
    kept, states, s, p, pooled, inside = tape
    t, n = ids.shape
    grad = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * m["w"]
    d_states = p[:, :, None] * d_pooled
    d_p = np.einsum("tnd,nd->tn", states, d_pooled)
    d_e = p * (d_p - (p * d_p).sum(axis=0))
    grad["v"] = np.einsum("tn,tna->a", d_e, s)
    d_s = (d_e[:, :, None] * m["v"] * (1 - s * s)).reshape(-1, ATTENTION)
    grad["a"] = states.reshape(-1, 2 * HIDDEN).T @ d_s
    d_states += (d_s @ m["a"].T).reshape(t, n, -1)
    h3 = 3 * HIDDEN
    d_x = np.zeros((t, n, 2 * h3), dtype=np.float32)
    d_h = [np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)]
    grad["u0"], grad["u1"] = np.zeros_like(m["u0"]), np.zeros_like(m["u1"])
    for side, i, h, z, r, c, g in reversed(kept):
        d = d_h[side] + d_states[i, :, side * HIDDEN : (side + 1) * HIDDEN]
        on = inside[i][:, None]
        d_c = d * (1 - z) * (1 - c * c) * on
        d_z = d * (h - c) * z * (1 - z) * on
        d_r = d_c * g * r * (1 - r)
        d_x[i, :, side * h3 : (side + 1) * h3] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
        u = f"u{side}"
        grad[u] += h.T @ d_g
        d_h[side] = np.where(on, d * z, d) + d_g @ m[u].T
    d_gates = _summed(len(gates), ids.ravel(), d_x.reshape(-1, 2 * h3))
    d_gates[-1] = 0
    return grad, d_gates


def _gates(m: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ m["x"] + m["b"], np.zeros((1, 6 * HIDDEN), np.float32)])


def window_scores(m: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and logit of every window."""
    ids, begin, words = _words(texts)
    doc, first, size = _windows(begin)
    gates = _gates(m, _inputs(m, *_hashed(words)))
    out = [_forward(m, gates, _matrix(ids, first[i : i + BATCH], size[i : i + BATCH], len(gates) - 1)) for i in range(0, len(doc), BATCH)]
    return doc, np.concatenate(out) if out else np.zeros(0, np.float32)


def fit(texts: list[bytes], toxic: np.ndarray, steps: int = 600, size: int = 96, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """The network, by ``steps`` steps of Adam over batches of ``size`` windows."""
    m, draw = new_model(seed), np.random.default_rng(seed)
    ids, begin, words = _words(texts)
    row, grams, at = _hashed(words)
    doc, first, length = _windows(begin)
    n_windows = np.bincount(doc, minlength=len(texts))
    base = np.cumsum(n_windows) - n_windows
    mean, square = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    queue: list[int] = []
    for step in range(1, steps + 1):
        if len(queue) < size:
            other = base + (draw.random(len(texts)) * n_windows).astype(int)
            if step <= steps // 3:
                chosen = other
            else:
                gates = _gates(m, _inputs(m, row, grams, at))
                logits = np.concatenate([_forward(m, gates, _matrix(ids, first[i : i + BATCH], length[i : i + BATCH], len(words))) for i in range(0, len(doc), BATCH)])
                by = np.lexsort((-logits, doc))
                chosen = np.concatenate([by[base], other[toxic == 0]])
            queue = [*queue, *draw.permutation(np.concatenate([chosen] * max(1, size // max(1, len(chosen)))))]
        batch, queue = np.array(queue[:size]), queue[size:]
        local = _matrix(ids, first[batch], length[batch], len(words))
        used = np.unique(local[local < len(words)])
        local = np.where(local < len(words), np.searchsorted(used, local), len(used))
        counts = (at[1:] - at[:-1])[used]
        mine = grams[np.repeat(at[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        own = np.concatenate(([0], np.cumsum(counts)))
        keep = (draw.random((len(used), 1)) > 0.3).astype(np.float32)  # now and then a word has its characters only
        x = _inputs(m, row[used], mine, own, keep)
        gates, tape = _gates(m, x), []
        d = (_sigmoid(_forward(m, gates, local, tape)) - toxic[doc[batch]]) / len(batch)
        grad, d_gates = _backward(m, gates, local, tape, d.astype(np.float32))
        grad["x"], grad["b"] = x.T @ d_gates[:-1], d_gates[:-1].sum(axis=0)
        d_x = d_gates[:-1] @ m["x"].T
        grad["word"] = _summed(WORD_ROWS, row[used], d_x[:, :WORD_DIM] * keep)
        grad["gram"] = _summed(GRAM_ROWS, mine, np.repeat(d_x[:, WORD_DIM:] / np.maximum(counts, 1)[:, None], counts, axis=0))
        for k, g in grad.items():
            g = g + 1e-5 * m[k]
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            m[k] -= (rate * (1 - 0.7 * step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, clean: int = 4000, toxic: int = 2000) -> bytes | None:
    """The weights of a network fitted on labelled documents that aren't held out; None if there are none.

    At most ``clean`` documents without and ``toxic`` with the label are taken, by a hash of the id: this bound, by which one task
    can train, is the only limit. Of several labels of an id the highest counts, of several texts of an id the first.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    by = F.xxhash64("doc_id")
    taken = told.where("toxic = 0").orderBy(by).limit(clean).unionByName(told.where("toxic = 1").orderBy(by).limit(toxic))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(taken), "doc_id")  # clean + toxic rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        m = fit([t.encode() for t in pdf["text"]], pdf["toxic"].to_numpy().astype(np.float32))
        out = io.BytesIO()
        np.savez(out, **m)
        return pd.DataFrame({"weights": [out.getvalue()]})

    got = rows.groupBy().applyInPandas(run, "weights binary").collect()  # one row of fixed size
    return bytes(got[0]["weights"]) if got else None


def score(docs: DataFrame, weights: bytes | None) -> DataFrame:
    """``docs`` (doc_id, text) with score, that of the worst window, and predicted; null texts are empty, and all scores are 0 without weights.

    Repeated rows get equal results; an empty table gives an empty one; other columns stay out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    if weights is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(held.value)) as z:
            m = dict(z)
        for batch in batches:
            texts, out = batch["text"].to_pylist(), []
            sizes = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                if len(part):
                    doc, logit = window_scores(m, [texts[i] for i in part])
                    worst = np.full(len(part), -np.inf)
                    np.maximum.at(worst, doc, logit)
                    out.append(_sigmoid(worst))
            value = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
