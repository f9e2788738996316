"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of gated units, one per direction, read the bytes of a text in windows with some bytes of context
on either side, so that a window's first and last positions are read in their surroundings; from both states the network
gives every byte position probabilities of the languages, and a document has the mean over its positions. All is numpy:
training is backpropagation through time with Adam on windows drawn from whole texts of a bounded sample of documents,
and prediction walks the windows of many texts side by side, step by step, so every byte of every text is labelled in
one narrow pass.

Units, with x the byte (its three rows of the tables hold embedding, input weights and biases in one), h the state:
z = sigmoid(Tz[x] + h Uz), r = sigmoid(Tr[x] + h Ur), n = tanh(Tn[x] + (r h) Un), h' = n + z (h - n).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import bounded_sample, fresh, held_out, keep
from wayfold.llm.packing import grouped

HIDDEN, WINDOW, CONTEXT, ROWS = 8, 64, 16, 2048
#: Bounds that do not grow with the data: documents in the training sample, and windows drawn from their whole texts.
SAMPLE, WINDOWS = 3_000, 60_000
STEPS, BATCH, RATE = 160, 384, 0.02
UNKNOWN = "und"
#: The pipeline drops documents whose best language has a smaller mean probability.
MIN_SCORE = 0.4
#: Texts are predicted together up to so many characters.
GROUP_CHARS = 1_000_000

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """The pattern may also find characters that are numbers of another kind; then each character is asked."""
    found = _LETTER.search(text) if text else None
    return bool(found) and (found[0].isalpha() or any(c.isalpha() for c in text[found.start() :]))


@dataclass
class Network:
    """``table``: (2 directions, 3 gates, 256, H); ``state``: (2, 3, H, H); ``out``: (2 H, C); ``bias``: (C)."""

    languages: list[str]
    table: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.state, self.out, self.bias]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(coded: list[bytes], width: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (width + 2 context, n) of all windows of all texts with their context, 0 beyond a text; the text of each
    window and how many of its own bytes are real."""
    lengths = np.array([len(c) for c in coded], dtype=np.int64)
    n = -(-lengths // width)
    of = np.repeat(np.arange(len(coded)), n)
    place = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * width
    # each text in a room of its own with the context's zeros on both sides
    rooms = n * width + 2 * context
    first = np.cumsum(rooms) - rooms
    flat = np.zeros(int(rooms.sum()) + width + 2 * context, dtype=np.uint8)
    for at, c in zip((first + context).tolist(), coded, strict=True):
        flat[at : at + len(c)] = np.frombuffer(c, dtype=np.uint8)
    x = np.lib.stride_tricks.sliding_window_view(flat, width + 2 * context)[first[of] + place]
    return x.T, of, np.minimum(width, lengths[of] - place)


def _steps(net: Network, d: int, x: np.ndarray, keep: bool = False):
    """States (L, B, H) of one direction; with ``keep`` also the gates of each step."""
    order = range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
    b, hidden = x.shape[1], net.out.shape[0] // 2
    states = np.empty((len(x), b, hidden), dtype=np.float32)
    h = np.zeros((b, hidden), dtype=np.float32)
    gates = {}
    # 0.5 tanh(x / 2) + 0.5 is the sigmoid: the halves go into the tables
    tz, tr, tn = 0.5 * net.table[d, 0], 0.5 * net.table[d, 1], net.table[d, 2]
    uz, ur, un = 0.5 * net.state[d, 0], 0.5 * net.state[d, 1], 0.5 * net.state[d, 2]
    z, r, n, m = (np.empty((b, hidden), dtype=np.float32) for _ in range(4))
    for t in order:
        at = x[t]
        np.take(tz, at, axis=0, out=z, mode="clip")
        np.matmul(h, uz, out=m)
        np.add(z, m, out=z)
        np.tanh(z, out=z)
        np.take(tr, at, axis=0, out=r, mode="clip")
        np.matmul(h, ur, out=m)
        np.add(r, m, out=r)
        np.tanh(r, out=r)
        np.add(r, 1, out=r)  # twice the gate; un is halved
        if keep:
            gates[t] = [h, 0.5 * r]
        np.multiply(r, h, out=r)
        np.matmul(r, un, out=m)
        np.take(tn, at, axis=0, out=n, mode="clip")
        np.add(n, m, out=n)
        np.tanh(n, out=n)
        np.add(z, 1, out=z)
        np.multiply(z, 0.5, out=z)
        np.subtract(h, n, out=m)
        np.multiply(m, z, out=m)
        if keep:
            gates[t] += [z.copy(), n.copy()]
        h = np.add(n, m, out=states[t])
    return states, gates


def label_positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities (L, B, C) of every position of the windows ``x`` (L, B)."""
    half = net.out.shape[0] // 2
    logits = _steps(net, 0, x)[0] @ net.out[:half]
    logits += _steps(net, 1, x)[0] @ net.out[half:]
    logits += net.bias
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def predict(net: Network, texts: list[str]) -> np.ndarray:
    """Mean probabilities (texts, C) over all byte positions; 0 for a text without bytes."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    x, of, real = windows(coded)
    sums = np.zeros((len(texts), len(net.languages)))
    step = np.arange(WINDOW)[:, None]
    for a in range(0, len(of), ROWS):
        p = label_positions(net, x[:, a : a + ROWS].astype(np.intp, order="C"))[CONTEXT : CONTEXT + WINDOW]
        if (real[a : a + ROWS] < WINDOW).any():
            p = p * (step < real[a : a + ROWS])[:, :, None]
        np.add.at(sums, of[a : a + ROWS], p.sum(axis=0))
    return sums / np.maximum(1, np.array([len(c) for c in coded]))[:, None]


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradients by backpropagation through time: the cross-entropy of every position."""
    half, (length, b) = net.out.shape[0] // 2, x.shape
    runs = [_steps(net, d, x, keep=True) for d in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    p = _softmax(both @ net.out + net.bias)
    loss = -float((np.log(p[:, np.arange(b), y] + 1e-9) * weight).sum()) / length
    p[:, np.arange(b), y] -= 1
    p *= weight[None, :, None] / np.float32(length)
    g_out = both.reshape(-1, 2 * half).T @ p.reshape(-1, p.shape[2])
    g_bias = p.sum(axis=(0, 1))
    g_both = p @ net.out.T
    g_table, g_state = np.zeros_like(net.table), np.zeros_like(net.state)
    for d in (0, 1):
        gates, g_h = runs[d][1], np.zeros((b, half), dtype=np.float32)
        uz, ur, un = net.state[d]
        for t in range(length - 1, -1, -1) if d == 0 else range(length):
            h, r, z, n = gates[t]
            g = g_h + g_both[t, :, d * half : (d + 1) * half]
            g_n = g * (1 - z) * (1 - n * n)
            g_z = g * (h - n) * z * (1 - z)
            back = g_n @ un.T
            g_r = back * h * r * (1 - r)
            g_h = g * z + back * r + g_z @ uz.T + g_r @ ur.T
            for k, (delta, source) in enumerate(((g_z, h), (g_r, h), (g_n, r * h))):
                g_state[d, k] += source.T @ delta
                for j in range(half):
                    g_table[d, k, :, j] += np.bincount(x[t], weights=delta[:, j], minlength=256)
    return loss, [g_table, g_state, g_out, g_bias]


def train(texts: list[str], langs: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> Network | None:
    """A network for the languages of ``langs``, from all windows of the texts."""
    x, of, real = windows([t.encode("utf-8", "replace") for t in texts])
    return train_windows(x, [langs[k] for k in of.tolist()], real, sorted(set(langs)), steps, hidden, seed)


def train_windows(x: np.ndarray, langs: list[str], real: np.ndarray, names: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> Network | None:
    """A network from windows (L, n), their languages and how many bytes of each are real; None without windows. Rare
    languages weigh more, by the root of their share."""
    full = np.flatnonzero(real >= WINDOW // 4)
    if not len(full):
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, langs)
    share = np.bincount(y[full], minlength=len(names)) / len(full)
    scale = 1 / np.sqrt(hidden)
    net = Network(
        names,
        rng.normal(0, 0.5, (2, 3, 256, hidden)).astype(np.float32),
        rng.uniform(-scale, scale, (2, 3, hidden, hidden)).astype(np.float32),
        rng.uniform(-scale, scale, (2 * hidden, len(names))).astype(np.float32),
        np.zeros(len(names), dtype=np.float32),
    )
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for k in range(1, steps + 1):
        rows = full[rng.integers(0, len(full), min(BATCH, len(full)))]
        weight = (1 / np.sqrt(share[y[rows]])).astype(np.float32)
        _, grads = gradients(net, x[:, rows].astype(np.intp), y[rows], weight / weight.sum())
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * k / steps)
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def train_on(documents: DataFrame, sample: int = SAMPLE, most_windows: int = WINDOWS) -> Network | None:
    """Trains on at most ``sample`` documents with a language that are not held out, those whose hashed doc_id is
    smallest, and of all windows of their whole texts on at most ``most_windows``, again by hash. Windows without a letter
    are left out."""
    rows = documents.where(~held_out("doc_id") & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = keep(bounded_sample(rows, "doc_id", sample, "text", "lang"))
    coded = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.ceil(F.octet_length(coded) / F.lit(WINDOW)).cast("int")
    begin = F.greatest(F.col("i") * WINDOW - CONTEXT, F.lit(0))
    piece = F.substring("coded", begin + 1, (F.col("i") + 1) * WINDOW + CONTEXT - begin)
    real = F.least(F.lit(WINDOW), F.octet_length("coded") - F.col("i") * WINDOW)
    cut = rows.select("lang", "h", coded.alias("coded"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("i"))
    cut = cut.select("lang", F.struct("h", "i").alias("place"), piece.alias("piece"), (F.col("i") == 0).alias("first"), real.alias("real"))
    found = [r for r in bounded_sample(cut, "place", most_windows, "piece", "lang").collect() if has_letter(bytes(r["piece"]).decode("utf-8", "ignore"))]
    if not found:
        return None
    width = WINDOW + 2 * CONTEXT
    # a text's first window has no bytes before it
    padded = b"".join((b"\0" * (CONTEXT if r["first"] else 0) + bytes(r["piece"])).ljust(width, b"\0") for r in found)
    x = np.frombuffer(padded, dtype=np.uint8).reshape(-1, width).T
    langs = [r["lang"] for r in found]
    return train_windows(x, langs, np.array([r["real"] for r in found]), sorted(set(langs)))


def _judge(net: Network | None, texts: list[str | None]) -> pd.DataFrame:
    lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
    at = [k for k, t in enumerate(texts) if has_letter(t)] if net else []
    for a, b in grouped([texts[k] for k in at], GROUP_CHARS):
        p = predict(net, [texts[k] for k in at[a:b]])
        lang[at[a:b]] = np.array(net.languages, dtype=object)[p.argmax(axis=1)]
        score[at[a:b]] = np.clip(p.max(axis=1), 0, 1)
    return pd.DataFrame({"lang_pred": lang, "score": score})


def judging(net: Network | None):
    """A pandas UDF: text -> struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        return _judge(net, text.tolist())

    return judge


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents`` (doc_id, text, lang).

    A null text, an empty one and one without a letter are ``und`` with score 0, and so are all if there is nothing to
    learn from. Repeated rows are repeated; source and other columns are ignored; no rows give none.
    """
    net = train_on(documents, sample)
    judged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), judging(net)(F.col("text")).alias("j"))
    return judged.select("doc_id", "held_out", "j.lang_pred", "j.score")


def keep_identified(documents: DataFrame, sample: int = SAMPLE, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``documents`` with a known language, their columns as they are: those that are ``und`` or whose mean
    probability is under ``min_score`` go."""
    columns = documents.columns
    (j,) = fresh(documents, "judged")
    judged = documents.withColumn(j, judging(train_on(documents, sample))(F.col("text")))
    return judged.where((F.col(j)["lang_pred"] != UNKNOWN) & (F.col(j)["score"] >= min_score)).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
