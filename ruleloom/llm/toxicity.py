"""Toxicity by a bidirectional gated recurrent network with attention pooling, over characters and words, in numpy.

A word is read letter by letter (its UTF-8 bytes) by a recurrent layer in both directions; attention pools the states. What comes out
and a vector of the word's own (for words of the training vocabulary) is the input of a second such layer over a window of words,
whose pooled states give the window's logit. Windows of WINDOW words begin every STRIDE words, the last ends with the text: they overlap, and
every word is in one or two. A text's score follows from the largest logit of its windows and from their mean probability.

Words of the vocabulary (in five texts or more) begin with how far the toxic texts that hold them exceed their share, in standard deviations beyond
three. Labels belong to texts, so training first takes
some windows of each text under its label, and then alternates: score all windows of the sample, and train on the highest of each toxic
text and the highest few of the others. A fifth of the sample stays out: it says which of the rounds' networks is taken, and calibrates
the scores. The sample is bounded (`Sample`): labelled texts in the order of a hash, toxic and other ones apart, up to numbers and bytes that
are parameters; one task learns from it, and the model alone reaches the driver.

Words are runs of ASCII letters and digits and of all that isn't ASCII, lower-cased (A-Z); one longer than PIECE bytes is read as several words. Null
and empty texts, and those without a word, have one window without words. Equal texts have equal scores. A document with several
labels is toxic if one is; labels other than 0 and 1 and those of no document are passed over. Without labels of both kinds every score is the share of toxic ones (0.5
without any). An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, _grown, cut, mix, sized_join, slices, trimmed

#: Words of a window and between the starts of two; bytes of a word.
WINDOW, STRIDE, PIECE = 32, 24, 24
#: Words are read as so many bytes, the shorter ones continued with blanks.
SPELLED = np.array([3, 6, 9, 12, PIECE])
#: Sizes: vectors of bytes and words, states of a direction, attention.
CHARS, VOCABULARY, STATE, ATTENTION = 8, 8, 8, 8
#: Words whose reading a worker keeps from slice to slice.
KEPT = 1 << 18
SPELT = 2 * STATE + CHARS
WORD_WIDTH = SPELT + VOCABULARY
#: Windows of a scoring batch and of a training step.
BATCH, STEP = 1024, 128


@dataclass
class Sample:
    """Bounds on what is learnt from: toxic and other texts, bytes of text in all; and how long."""

    toxic: int = 1000
    other: int = 2000
    text_bytes: int = 16 << 20
    rounds: int = 3
    rate: float = 0.01
    decay: float = 0.002


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


# --- layers -----------------------------------------------------------------------------------------------------------------


def recurrent(gates: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States [T, n, H] of a gated recurrent layer; gates [T, n, 3 H] are what the inputs give to update, reset and candidate."""
    steps, n, width = gates.shape
    h = np.zeros((n, width // 3), gates.dtype)
    states, kept = np.empty((steps, n, width // 3), gates.dtype), []
    for t in range(steps):
        g, back = gates[t], h @ u
        s = len(h[0]) if n else width // 3
        zr = sigmoid(g[:, : 2 * s] + back[:, : 2 * s])
        z, r, b = zr[:, :s], zr[:, s:], back[:, 2 * s :]
        new = np.tanh(g[:, 2 * s :] + r * b)
        if keep:
            kept.append((h, z, r, b, new))
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def recurrent_back(d: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of u from those of the states."""
    steps, n, s = d.shape
    gates, du, dh = np.empty((steps, n, 3 * s), d.dtype), np.zeros_like(u), np.zeros((n, s), d.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, b, new = kept[t]
        dh = dh + d[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz, dr = dh * (h - new) * z * (1 - z), dnew * b * r * (1 - r)
        gates[t] = np.concatenate([dz, dr, dnew], 1)
        dback = np.concatenate([dz, dr, dnew * r], 1)
        du += h.T @ dback
        dh = dh * z + dback @ u.T
    return gates, du


def pooled(h: np.ndarray, p: dict, name: str) -> tuple[np.ndarray, tuple]:
    """States [T, n, D] summed under attention weights [T, n]."""
    a = np.tanh(h @ p[name + "_att"] + p[name + "_att_b"])
    e = a @ p[name + "_att_v"]
    e = np.exp(e - e.max(0))
    w = e / e.sum(0)
    return (w[:, :, None] * h).sum(0), (h, a, w)


def pooled_back(d: np.ndarray, kept: tuple, p: dict, name: str, grads: dict) -> np.ndarray:
    h, a, w = kept
    dw = (h * d).sum(2)
    de = w * (dw - (w * dw).sum(0))
    da = de[:, :, None] * p[name + "_att_v"] * (1 - a * a)
    grads[name + "_att_v"] += np.tensordot(de, a, ([0, 1], [0, 1]))
    grads[name + "_att"] += np.tensordot(h, da, ([0, 1], [0, 1]))
    grads[name + "_att_b"] += da.sum((0, 1))
    return w[:, :, None] * d + da @ p[name + "_att"].T


def layer(inputs: np.ndarray, table: np.ndarray, at: np.ndarray, p: dict, name: str, keep: bool) -> tuple[np.ndarray, tuple]:
    """Both directions and pooling of states and inputs: table [m, 6 H] has the gates of each of the inputs [m, D], at [n, T] says which
    inputs come."""
    s = p[name + "_u0"].shape[0]
    gates = table[at.T]
    ahead, a = recurrent(gates[:, :, : 3 * s], p[name + "_u0"], keep)
    back, b = recurrent(gates[::-1, :, 3 * s :], p[name + "_u1"], keep)
    out, c = pooled(np.concatenate([ahead, back[::-1], inputs[at.T]], 2), p, name)
    return out, (a, b, c)


def gathered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place."""
    return np.stack([np.bincount(at, v, n) for v in values.T], 1).astype(values.dtype)


def layer_back(d: np.ndarray, kept: tuple, at: np.ndarray, p: dict, name: str, grads: dict, dinputs: np.ndarray, dtable: np.ndarray) -> None:
    """Adds to the gradients of the parameters, of the inputs and of the table."""
    a, b, c = kept
    dh = pooled_back(d, c, p, name, grads)
    s = p[name + "_u0"].shape[0]
    g0, u0 = recurrent_back(dh[:, :, :s], a, p[name + "_u0"])
    g1, u1 = recurrent_back(dh[::-1, :, s : 2 * s], b, p[name + "_u1"])
    grads[name + "_u0"] += u0
    grads[name + "_u1"] += u1
    dinputs += gathered(at.T.ravel(), dh[:, :, 2 * s :].reshape(-1, dinputs.shape[1]), len(dinputs))
    dtable += gathered(at.T.ravel(), np.concatenate([g0, g1[::-1]], 2).reshape(-1, 6 * s), len(dtable))


# --- the network ------------------------------------------------------------------------------------------------------------


def initial(words: np.ndarray, seed: int = 7, kind: type = np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    some = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(kind)
    p = {"chars": some(256, CHARS) * 4, "words": np.zeros((len(words) + 1, VOCABULARY), kind)}
    p["words"][1:, 0] = words
    for name, width in (("c", CHARS), ("w", WORD_WIDTH)):
        p |= {name + "_x": some(width, 6 * STATE), name + "_b": np.zeros(6 * STATE, kind), name + "_u0": some(STATE, 3 * STATE), name + "_u1": some(STATE, 3 * STATE)}
        p |= {name + "_att": some(2 * STATE + width, ATTENTION), name + "_att_b": np.zeros(ATTENTION, kind), name + "_att_v": some(ATTENTION)}
    p |= {"out": some(2 * STATE + WORD_WIDTH), "out_b": np.zeros(1, kind)}
    at = 2 * STATE + SPELT  # the first component of a word's own vector: attention goes to it, and it speaks for toxicity
    p["w_att"][at, 0], p["w_att_v"][0], p["out"][at] = 1.0, 3.0, 2.0
    return p


@dataclass
class Pieces:
    """Words of some texts: distinct ones as (start, end) in the bytes and number in the vocabulary (0: none), each place's word, and each text's
    first place (one more: the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    known: np.ndarray
    at: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, vocabulary: np.ndarray) -> Pieces:
        w = Words(texts, WORD, hashed=False)
        parts = -(-(w.end - w.start) // PIECE)
        word = np.repeat(np.arange(len(parts)), parts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = w.start[word] + PIECE * place
        end = np.minimum(start + PIECE, w.end[word])
        first = np.r_[0, np.cumsum(parts)][w.first]
        n = len(w.data)
        power, inverse = _grown(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        h, one, at = np.unique(h, return_index=True, return_inverse=True)
        known = np.zeros(len(h), np.int64)
        if len(vocabulary):
            i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = np.where(vocabulary[i] == h, i + 1, 0)
        return cls(w.data, start[one], end[one], known, at, first, h)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first place and number of words of each window, by text and place; texts without words have one, of no words."""
        n = np.diff(self.first)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(n)), count)
        j = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return text, self.first[text] + np.minimum(j * STRIDE, np.maximum(0, n - WINDOW)[text]), np.minimum(n, WINDOW)[text]

    def places(self, begin: np.ndarray, size: int) -> np.ndarray:
        """The words of windows of one size, [n, size]."""
        return self.at[begin[:, None] + np.arange(size)]


    def letters(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in `some` with the bytes of their words, by spelled size."""
        length = (self.end - self.start)[some]
        for size, i in by_size(SPELLED[np.searchsorted(SPELLED, length)], BATCH):
            at = self.start[some[i]][:, None] + np.arange(size)
            inside = np.arange(size) < length[i][:, None]
            yield i, np.where(inside, self.data[np.where(inside, at, 0)], 0x20)


def by_size(size: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of one size, in batches."""
    order = np.argsort(size, kind="stable")
    at = np.flatnonzero(np.r_[len(order) > 0, np.diff(size[order]) > 0])
    for a, b in zip(at, np.r_[at[1:], len(order)], strict=True):
        for i in range(a, b, most):
            yield int(size[order[i]]), order[i : min(i + most, b)]


def read_words(p: dict, x: Pieces, some: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """What the first layer and the vocabulary give for the distinct words `some`."""
    table = p["chars"] @ p["c_x"] + p["c_b"]
    out, kept = np.empty((len(some), WORD_WIDTH), table.dtype), []
    for i, letters in x.letters(some):
        out[i, :SPELT], k = layer(p["chars"], table, letters, p, "c", keep)
        if keep:
            kept.append((i, letters, k))
    out[:, SPELT:] = p["words"][x.known[some]]
    return out, kept


def window_logits(p: dict, x: Pieces, begin: np.ndarray, size: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """words: what the first layer gives for the distinct words, where that is there already."""
    if words is None:
        words = read_words(p, x, np.arange(len(x.start)), False)[0]
    table = words @ p["w_x"] + p["w_b"]
    out = np.full(len(begin), p["out_b"][0], np.float64)
    for n, i in by_size(size, BATCH):
        if n:
            out[i] += layer(words, table, x.places(begin[i], n), p, "w", False)[0] @ p["out"]
    return out


def gradients(p: dict, x: Pieces, begin: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, forget: np.ndarray) -> tuple[float, dict]:
    """Weighted log loss of windows and its gradients; `forget` says which distinct words are read without the vocabulary."""
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    groups = list(by_size(size, len(size)))
    used, back = np.unique(np.concatenate([x.places(begin[i], n).ravel() for n, i in groups]), return_inverse=True)
    inputs, kept = read_words(p, x, used, True)
    inputs[forget[used], SPELT:] = 0
    table = inputs @ p["w_x"] + p["w_b"]
    dinputs, dtable, loss, at = np.zeros_like(inputs), np.zeros_like(table), 0.0, 0
    for n, i in groups:
        places = back[at : at + n * len(i)].reshape(len(i), n)
        at += n * len(i)
        if n:
            out, k = layer(inputs, table, places, p, "w", True)
            z = out @ p["out"] + p["out_b"]
        else:
            out, z = np.zeros((len(i), len(p["out"])), table.dtype), np.repeat(p["out_b"], len(i))
        loss += float((weight[i] * (np.logaddexp(0, z) - label[i] * z)).sum())
        d = (weight[i] * (sigmoid(z) - label[i])).astype(table.dtype)
        grads["out"] += out.T @ d
        grads["out_b"] += d.sum()
        if n:
            layer_back(d[:, None] * p["out"], k, places, p, "w", grads, dinputs, dtable)
    grads["w_x"] += inputs.T @ dtable
    grads["w_b"] += dtable.sum(0)
    dinputs += dtable @ p["w_x"].T
    learn = ~forget[used] & (x.known[used] > 0)
    grads["words"] += gathered(x.known[used][learn], dinputs[learn, SPELT:], len(grads["words"]))
    dchars = np.zeros((256, 6 * STATE), table.dtype)
    for i, letters, k in kept:
        layer_back(dinputs[i, :SPELT], k, letters, p, "c", grads, grads["chars"], dchars)
    grads["c_x"] += p["chars"].T @ dchars
    grads["c_b"] += dchars.sum(0)
    grads["chars"] += dchars @ p["c_x"].T
    return loss, grads


class Steps:
    """Adam."""

    def __init__(self, p: dict, rate: float, decay: float):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-12))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] *= 1 - self.rate * self.decay * (k != "chars")
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.p[k].dtype)


# --- learning and scoring ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Parameters, the vocabulary's sorted hashes, weights of a text's signs in its score; without parameters `share` is every score.
    hash and words: what the first layer gave for words that came before."""

    p: dict = field(default_factory=dict)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    share: float = 0.5
    hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, WORD_WIDTH), np.float32))

    def read(self, x: Pieces) -> np.ndarray:
        at = np.searchsorted(self.hash, x.hash)
        there = at < len(self.hash)
        there[there] = self.hash[at[there]] == x.hash[there]
        out = np.empty((len(x.hash), WORD_WIDTH), np.float32)
        out[there], new = self.words[at[there]], np.flatnonzero(~there)
        out[new] = read_words(self.p, x, new, False)[0]
        if len(self.hash) + len(new) > KEPT:
            self.hash, self.words = x.hash, out
        else:
            h = np.concatenate([self.hash, x.hash[new]])
            order = np.argsort(h)
            self.hash, self.words = h[order], np.concatenate([self.words, out[new]])[order]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), self.share)
        x = Pieces.of(texts, self.vocabulary)
        text, begin, size = x.windows()
        return np.round(sigmoid(signs(window_logits(self.p, x, begin, size, self.read(x)), text) @ self.weights), 6)


def signs(logits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each text the largest logit, the logit of its windows' mean probability, and one; windows lie by text."""
    if not len(text):
        return np.zeros((0, 3))
    at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    mean = np.clip(np.add.reduceat(sigmoid(logits), at) / np.diff(np.r_[at, len(text)]), 1e-4, 1 - 1e-4)
    return np.stack([np.clip(np.maximum.reduceat(logits, at), -20, 20), np.log(mean / (1 - mean)), np.ones(len(at))], 1)


def learnt(texts: list[str], toxic: np.ndarray, bounds: Sample, seed: int = 7) -> Model:
    """A model of labelled texts."""
    if not (0 < toxic.sum() < len(toxic)):
        return Model(share=float((toxic.sum() + 0.5) / (len(toxic) + 1)) if len(toxic) else 0.5)
    rng = np.random.default_rng(seed)
    x = Pieces.of(pa.array(texts, pa.large_string()), np.zeros(0, np.uint64))
    apart = np.zeros(len(texts), bool)
    for kind in (0, 1):
        of = np.flatnonzero(toxic == kind)
        if len(of) >= 5:
            apart[of[::5]] = True
    document = np.repeat(np.arange(len(texts)), np.diff(x.first))
    pairs = np.unique(document * len(x.hash) + x.at)
    pairs = pairs[~apart[pairs // max(1, len(x.hash))]]
    held = np.bincount(pairs % max(1, len(x.hash)), minlength=len(x.hash))
    bad = np.bincount(pairs % max(1, len(x.hash)), toxic[pairs // max(1, len(x.hash))], minlength=len(x.hash))
    often = held >= 5
    share = toxic[~apart].mean()
    surprise = (bad - held * share) / np.sqrt(held * share * (1 - share) + 1)
    p = initial(np.clip(np.sign(surprise) * (np.abs(surprise) - 3) / 3 * (np.abs(surprise) > 3), -1, 2)[often], seed)
    vocabulary = x.hash[often]
    x.known = np.where(often, np.cumsum(often), 0)
    text, begin, size = x.windows()
    steps = Steps(p, bounds.rate, bounds.decay)
    calibrates = apart if 0 < toxic[apart].sum() < apart.sum() else np.ones(len(texts), bool)

    def train(chosen: np.ndarray, passes: int) -> None:
        label = toxic[text[chosen]].astype(np.float32)
        of_toxic = label.mean()
        weight = np.where(label > 0, 0.5 / max(of_toxic, 1e-3), 0.5 / max(1 - of_toxic, 1e-3)).astype(np.float32)
        for _ in range(passes):
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), STEP):
                o = order[i : i + STEP]
                forget = rng.random(len(x.start)) < 0.15
                steps.step(gradients(p, x, begin[chosen[o]], size[chosen[o]], label[o], weight[o] / len(o), forget)[1])

    used = np.flatnonzero(~apart[text])
    train(ranked(used, text[used], rng.random(len(used)), lambda t: 6), 1)
    best: tuple = (np.inf,)
    for k in range(bounds.rounds + 1):
        logits = window_logits(p, x, begin, size)
        found = signs(logits, text)[calibrates]
        weights = calibrated(found, toxic[calibrates])
        loss = float(np.mean(np.logaddexp(0, found @ weights) - toxic[calibrates] * (found @ weights)))
        if loss < best[0]:
            best = (loss, {n: v.copy() for n, v in p.items()}, weights)
        elif k > 1:
            break
        if k < bounds.rounds:
            steps.rate = bounds.rate * 0.5 ** (k / 2)
            hard = ranked(used, text[used], logits[used], lambda t: np.where(toxic[t] == 1, 2, 3))
            clean = used[toxic[text[used]] == 0]
            train(np.concatenate([hard, ranked(clean, text[clean], rng.random(len(clean)), lambda t: 1)]), 3)
    _, p, weights = best
    return Model(p, vocabulary, weights)


def ranked(windows: np.ndarray, text: np.ndarray, value: np.ndarray, most: Callable[[np.ndarray], np.ndarray | int]) -> np.ndarray:
    """The windows of the highest values of each text."""
    order = np.lexsort((-value, text))
    t = text[order]
    at = np.flatnonzero(np.r_[len(t) > 0, t[1:] != t[:-1]])
    place = np.arange(len(t)) - np.repeat(at, np.diff(np.r_[at, len(t)]))
    return windows[order[place < most(t)]]


def calibrated(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, towards targets that leave room for one more of either kind; none but the last is below zero."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, use = np.array([0.5, 0.5, 0.0]), np.ones(3, bool)
    for _ in range(3):
        for _ in range(50):
            z = x[:, use]
            q = sigmoid(z @ w[use])
            g = z.T @ (q - target) + 0.1 * (w - [0.5, 0.5, 0.0])[use] * [1, 1, 0.01][-use.sum() :]
            h = (z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.diag([1, 1, 0.01][-use.sum() :])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            w[use] -= step
            if np.abs(step).max() < 1e-9:
                break
        below = (w < 0) & [True, True, False]
        if not below.any():
            break
        use &= ~below
        w[below] = 0
    return w


def fit(documents: DataFrame, labels: DataFrame, bounds: Sample | None = None) -> Model:
    """A model of the labelled documents (doc_id, text), of which one task learns from a bounded sample."""
    bounds = bounds or Sample()
    label = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select("doc_id", F.xxhash64(text, F.lit(12)).alias("key"), F.octet_length(text).cast("long").alias("size"))
    known = cut(sized_join(keyed.where(F.col("doc_id").isNotNull()), cut(label), ["doc_id"], "inner"))
    picked, room = [], bounds.text_bytes
    for kind, most in ((1, bounds.toxic), (0, bounds.other)):
        left = room // 2 if kind else room
        for r in known.where(F.col("toxic") == kind).orderBy("key", "doc_id").limit(most).collect():
            if r["size"] <= left:
                picked.append((r["doc_id"], r["key"], kind))
                left -= r["size"]
                room -= r["size"]
    if not picked:
        return Model()
    spark = documents.sparkSession
    wanted = spark.createDataFrame(picked, "doc_id long, key long, toxic int").dropDuplicates(["doc_id", "key"])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.lit(12)).alias("key")).join(F.broadcast(wanted), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((r["key"], r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        if found:
            model = learnt([r[2] for r in found], np.array([r[3] for r in found], np.int64), bounds)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    return pickle.loads(bytes(rows.repartition(1).mapInArrow(trimmed(work), "model binary").first()["model"]))


def toxicity(documents: DataFrame, model: Model, keep: list[str | Column], threshold: float = 0.7) -> DataFrame:
    """The kept columns, score, and predicted (1 from the threshold on) of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    out = [f for f in rows.schema.fields if f.name != "__text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "__text"):
                score = model.scores(part.column("__text"))
                kept = [part.column(f.name) for f in out]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*(f.name for f in out), "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "score double, predicted int"])
    return rows.mapInArrow(trimmed(work), schema)
