"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

Two gated recurrent layers read a text's bytes, one from each end, across word limits; every byte gets class
probabilities, and a document's are the average over all its bytes outside white space. The network is trained in numpy by
backpropagation through time on windows of a bounded sample of documents with a known language. A text is labelled in
stretches of `CORE` bytes; each layer's state is warmed up over the `WARM` bytes before the stretch in its direction, so a
text of any length takes steps of bounded size, and one of at most `CORE` bytes is read by a single run of both layers.

Text that is null or has no letter is `und` with score 0, as is every text when nothing could be learned; duplicated ids
are predicted row by row; equal shares go to the first language by name; an empty table gives an empty result; a very long
text is read in stretches and every byte counts; other columns are kept, except those with the names of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .learn import Adagrad, held_out, taught

HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 2, 128, 0.05, 3
#: Bytes of a stretch and of the warm-up before it, and stretches labelled together: so few that products use one thread.
CORE, WARM, TOGETHER = 448, 32, 960
#: Documents, and windows of each language and their bytes, that the network is fitted on, at most.
DOCUMENTS, WINDOWS, WIDE = 1500, 2000, 64


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer; gates in the order update, reset, candidate."""

    def __init__(self, r: np.random.Generator):
        h = HIDDEN
        self.look = (r.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)  # a byte's part of each gate
        self.back = (r.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.bias = np.zeros(3 * h, np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States after each step of x (rows, steps); masked steps leave the state as it is."""
        h, state, states, seen = HIDDEN, np.zeros((len(x), HIDDEN), np.float32), [], []
        for t in range(x.shape[1]):
            a = self.look[x[:, t]] + self.bias
            b = state @ self.back[:, : 2 * h]
            zr = sigmoid(a[:, : 2 * h] + b)
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + (r * state) @ self.back[:, 2 * h :])
            m = mask[:, t, None]
            new = state + m * z * (n - state)
            if keep:
                seen.append((state, z, r, n))
            state = new
            states.append(state)
        return np.stack(states, axis=1), seen

    def steps(self, x: np.ndarray, mask: np.ndarray):
        """The state after each step of x (steps, rows), as in forward().

        Gates by exponentials, which numpy computes in less than half the time of tanh: a gate of -a is 1 / (1 + exp(a)), and
        tanh(a / 2) is 1 - 2 / (1 + exp(a)). An exponential that overflows gives the limit.
        """
        h = HIDDEN
        sign = np.repeat(np.array([-1, -1, 2], np.float32), h)
        look, back = (self.look + self.bias) * sign, self.back * sign
        look_z, look_r, look_n = (np.ascontiguousarray(look[:, i * h : i * h + h]) for i in range(3))
        back_z, back_r, back_n = (np.ascontiguousarray(back[:, i * h : i * h + h]) for i in range(3))
        state = np.zeros((x.shape[1], h), np.float32)
        r, n, z, part = (np.empty_like(state) for _ in range(4))
        whole = mask.all(axis=1)
        for t in range(len(x)):  # gates apart, each without gaps in memory
            with np.errstate(over="ignore"):
                look_r.take(x[t], axis=0, out=r, mode="clip")
                r += np.matmul(state, back_r, out=part)
                np.exp(r, out=r)
                r += 1
                np.divide(state, r, out=r)
                look_n.take(x[t], axis=0, out=n, mode="clip")
                n += np.matmul(r, back_n, out=part)
                np.exp(n, out=n)
                n += 1
                np.divide(-2, n, out=n)
                n += 1
                n -= state
                look_z.take(x[t], axis=0, out=z, mode="clip")
                z += np.matmul(state, back_z, out=part)
                np.exp(z, out=z)
                z += 1
                n /= z
            if not whole[t]:
                n *= mask[t, :, None]
            state += n
            yield state

    def backward(self, x, mask, seen, grad, opt: Adagrad, name: str) -> None:
        """Backpropagation through time of the gradients of all states."""
        h = HIDDEN
        g_look, g_back = np.zeros_like(self.look), np.zeros_like(self.back)
        flow = np.zeros((len(x), h), np.float32)
        made = []
        for t in range(x.shape[1] - 1, -1, -1):
            state, z, r, n = seen[t]
            m = mask[:, t, None]
            g = flow + grad[:, t]
            dz = g * m * (n - state) * z * (1 - z)
            dn = g * m * z * (1 - n * n)
            drs = dn @ self.back[:, 2 * h :].T
            dr = drs * state * r * (1 - r)
            made.append(np.concatenate([dz, dr, dn], axis=1))
            flow = g * (1 - m * z) + drs * r + made[-1][:, : 2 * h] @ self.back[:, : 2 * h].T
        gates = np.concatenate(made[::-1])
        state, reset = np.concatenate([k[0] for k in seen]), np.concatenate([k[2] for k in seen])
        g_back[:, : 2 * h] = state.T @ gates[:, : 2 * h]
        g_back[:, 2 * h :] = (reset * state).T @ gates[:, 2 * h :]
        g_bias = gates.sum(axis=0)
        there, which = np.unique(x.T.ravel(), return_inverse=True)
        one = np.zeros((len(which), len(there)), np.float32)  # a gate's part of its byte, summed by a product
        one[np.arange(len(which)), which] = 1
        g_look[there] = one.T @ gates
        for part, g in (("look", g_look), ("back", g_back), ("bias", g_bias)):
            opt.step(name + part, getattr(self, part), g)


class Network:
    def __init__(self, classes: int):
        r = np.random.default_rng(SEED)
        self.ahead, self.behind = Direction(r), Direction(r)
        self.out = (r.standard_normal((2 * HIDDEN, classes)) * 0.1).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def states(self, x, mask, keep=False):
        a, sa = self.ahead.forward(x, mask, keep)
        b, sb = self.behind.forward(x[:, ::-1], mask[:, ::-1], keep)
        return np.concatenate([a, b[:, ::-1]], axis=2), sa, sb

    def label(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Class probabilities, summed over the bytes outside white space, of each stretch start : start + size of texts lo : hi."""
        wide, h = int(size.max()), HIDDEN
        at = start + np.arange(-WARM, wide + WARM)[:, None]
        inside = (at >= lo) & (at < hi)
        x = buf[np.clip(at, 0, len(buf) - 1)]
        z = np.empty((wide, len(self.bias), len(start)), np.float32)
        for t, state in enumerate(self.ahead.steps(x[: WARM + wide], inside[: WARM + wide])):
            if t >= WARM:
                np.matmul(self.out[:h].T, state.T, out=z[t - WARM])
        for t, state in enumerate(self.behind.steps(x[:WARM - 1 : -1], inside[:WARM - 1 : -1])):
            if t >= WARM:
                z[wide - 1 - (t - WARM)] += self.out[h:].T @ state.T
        z += self.bias[:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        use = (np.arange(wide)[:, None] < size) & ~C.SPACE[x[WARM : WARM + wide]]
        z *= (use / z.sum(axis=1)).astype(np.float32)[:, None]
        return z.sum(axis=0, dtype=np.float64).T

    def learn(self, x, size, y, opt: Adagrad) -> None:
        mask = (np.arange(x.shape[1]) < size[:, None]).astype(np.float32)
        s, sa, sb = self.states(x, mask, keep=True)
        z = s @ self.out + self.bias
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(len(y)), :, y] -= 1
        p *= mask[:, :, None] / mask.sum()
        g = p @ self.out.T
        opt.step("out", self.out, np.einsum("bth,btc->hc", s, p))
        opt.step("obias", self.bias, p.sum(axis=(0, 1)))
        self.ahead.backward(x, mask, sa, g[:, :, :HIDDEN], opt, "ahead")
        self.behind.backward(x[:, ::-1], mask[:, ::-1], sb, g[:, ::-1, HIDDEN:], opt, "behind")


def stretches(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, row) of the stretches of rows off[i]:off[i+1]; an empty row has none."""
    n = -(-np.diff(off) // CORE)
    row = np.repeat(np.arange(len(n)), n)
    start = off[row] + CORE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(CORE, off[row + 1] - start), row


def shares(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Summed class probabilities of every row; stretches of like length run together."""
    start, size, row = stretches(off)
    out = np.zeros((len(off) - 1, len(net.bias)))
    order = np.argsort(size, kind="stable")
    for i in range(0, len(order), TOGETHER):
        o = order[i : i + TOGETHER]
        np.add.at(out, row[o], net.label(buf, start[o], size[o], off[row[o]], off[row[o] + 1]))
    return out


def fit(rows: list[tuple[bytes, str]]):
    """(network, languages)."""
    names = sorted({y for _, y in rows})
    r = np.random.default_rng(SEED)
    xs, sizes, ys = [], [], []
    for k, name in enumerate(names):
        body = b" ".join(b for b, y in rows if y == name)
        buf = np.frombuffer(body, np.uint8)
        if not len(buf):
            continue
        first = r.integers(0, max(1, len(buf) - WIDE + 1), WINDOWS)
        at = first[:, None] + np.arange(WIDE)
        xs.append(np.where(at < len(buf), buf[np.minimum(at, len(buf) - 1)], 0))
        sizes.append(np.minimum(WIDE, len(buf) - first))
        ys.append(np.full(WINDOWS, k))
    if not xs:
        return None
    x, size, y = np.concatenate(xs), np.concatenate(sizes), np.concatenate(ys)
    net, opt = Network(len(names)), Adagrad(RATE)
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for i in range(0, len(x), BATCH):
            p = order[i : i + BATCH]
            net.learn(x[p], size[p], y[p], opt)
    return net, names


def predict(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with lang_pred and score."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = C.short_batches(docs).select(F.struct(*rest).alias("rest"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col(text).alias("body"))

    def run(batches):
        for batch in batches:
            letter = batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = C.flat(batch.column(2))
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            if told.value:
                names = np.array(told.value[1], object)
                for lo, hi in C.pieces(off):
                    b, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                    total = shares(told.value[0], b, o)
                    use = letter[lo:hi] & (total.sum(axis=1) > 0)
                    share = total[use] / total[use].sum(axis=1, keepdims=True)
                    lang[lo:hi][use], score[lo:hi][use] = names[share.argmax(axis=1)], share.max(axis=1)
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["rest", "lang_pred", "score"])

    return rows.mapInArrow(run, f"rest {rows.dtypes[0][1]}, lang_pred string, score double").select("rest.*", "lang_pred", "score")


def learn_languages(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang"):
    rows = taught(docs, docs, lang, text, key, DOCUMENTS)
    return fit(rows) if rows else None


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs.drop("lang"), learn_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
