"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a stretch of bytes from either side; a softmax over both states labels every position, and a document's
probabilities are the mean over the positions of its letters. The network is trained here, in numpy, by backpropagation
through time on windows of labelled texts. Prediction runs over whole texts, thousands of stretches at a time.

Defined results: a null text, or one without a letter, is und with score 0; so is every text if nothing is labelled;
repeated rows get equal results; rows with null lang are predicted but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, views, without

HIDDEN = 12
#: Bytes that are read in one stretch; the states start anew at its ends.
STRETCH = 192
#: The training sample: documents of each language, at most, and characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 400, 480
WINDOW, BATCH, STEPS, RATE = 48, 192, 160, 0.02

#: Bytes of letters: a position of any other is not pooled.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x41:0x5B] = IS_LETTER[0x61:0x7B] = IS_LETTER[0x80:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class Network:
    """Parameters for each direction d: E, a row for each byte; U, from state to gates; W, from state to labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden, c = labels, hidden, len(labels)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in (0, 1) for k, v in (("E", normal(256, 3 * hidden) * 8), ("U", normal(hidden, 3 * hidden)), ("W", normal(hidden, c)))}
        self.p["b"] = np.zeros(c, np.float32)

    def _run(self, d: int, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: bytes, time first. The labels' share of this direction at each time, and what the way back needs."""
        h_size = self.hidden
        e, u, w = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"W{d}"]
        h = np.zeros((x.shape[1], h_size), np.float32)
        out, kept = np.empty((*x.shape, w.shape[1]), np.float32), []
        for t in range(len(x)):
            a, g = e[x[t]], h @ u
            zr = _sigmoid(a[:, : 2 * h_size] + g[:, : 2 * h_size])
            z, r, gn = zr[:, :h_size], zr[:, h_size:], g[:, 2 * h_size :]
            n = np.tanh(a[:, 2 * h_size :] + r * gn)
            if keep:
                kept.append((h, z, r, gn, n))
            h = n + z * (h - n)
            np.matmul(h, w, out=out[t])
        if keep:
            kept.append((h,))
        return out, kept

    def _states(self, d: int, x: np.ndarray) -> np.ndarray:
        """The labels' share of this direction at each time, label first; gates are rows, so that each is contiguous."""
        h_size, lanes = self.hidden, x.shape[1]
        half = np.ones((3 * h_size, 1), np.float32)
        half[: 2 * h_size] = 0.5  # a logistic gate is a tanh of half its input, moved
        e, u, w = np.ascontiguousarray(self.p[f"E{d}"].T * half), np.ascontiguousarray(self.p[f"U{d}"].T * half), np.ascontiguousarray(self.p[f"W{d}"].T)
        h, a, g = np.zeros((h_size, lanes), np.float32), np.empty((3 * h_size, lanes), np.float32), np.empty((3 * h_size, lanes), np.float32)
        zr, n, gn = a[: 2 * h_size], a[2 * h_size :], g[2 * h_size :]
        out = np.empty((len(x), len(w), lanes), np.float32)
        for t in range(len(x)):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            zr += g[: 2 * h_size]
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            gn *= zr[h_size:]
            n += gn
            np.tanh(n, out=n)
            h -= n
            h *= zr[:h_size]
            h += n
            np.matmul(w, h, out=out[t])
        return out

    def label(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities at each position, by time, label and stretch; x: bytes, a row for each stretch, filled up with zeros."""
        back = np.maximum(size[:, None] - 1 - np.arange(x.shape[1]), 0)
        out = self._states(0, np.ascontiguousarray(x.T))
        other = self._states(1, np.ascontiguousarray(np.take_along_axis(x, back, 1).T))
        out += np.take_along_axis(other, np.ascontiguousarray(back.T)[:, None, :], 0)
        out += self.p["b"][:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """x: bytes, time first, all stretches full; y: the label of each stretch. Loss over the letters' positions."""
        h_size, t_size = self.hidden, len(x)
        sides = [(x, *self._run(0, x, True)), (x[::-1], *self._run(1, x[::-1], True))]
        p = sides[0][1] + sides[1][1][::-1] + self.p["b"]
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        on = IS_LETTER[x].astype(np.float32)
        total = max(1.0, float(on.sum()))
        loss = -float((np.log(p[:, np.arange(x.shape[1]), y] + 1e-9) * on).sum()) / total
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= (on / np.float32(total))[:, :, None]
        grads = {"b": p.sum(axis=(0, 1))}
        for d, (xs, _, kept) in enumerate(sides):
            u, w, dp = self.p[f"U{d}"], self.p[f"W{d}"], p if d == 0 else p[::-1]
            du, dw = np.zeros_like(u), np.zeros_like(w)
            da = np.empty((t_size, x.shape[1], 3 * h_size), np.float32)
            dh = np.zeros((x.shape[1], h_size), np.float32)
            for t in range(t_size - 1, -1, -1):
                h, z, r, gn, n = kept[t]
                after = kept[t + 1][0]
                dw += after.T @ dp[t]
                dh = dh + dp[t] @ w.T
                dn = dh * (1 - z) * (1 - n * n)
                da[t, :, :h_size] = dh * (h - n) * z * (1 - z)
                da[t, :, h_size : 2 * h_size] = dn * gn * r * (1 - r)
                da[t, :, 2 * h_size :] = dn
                dg = da[t].copy()
                dg[:, 2 * h_size :] *= r
                du += h.T @ dg
                dh = dh * z + dg @ u.T
            flat = xs.ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            de = np.zeros_like(self.p[f"E{d}"])
            de[flat[order][first]] = np.add.reduceat(da.reshape(-1, 3 * h_size)[order], first)
            grads |= {f"E{d}": de, f"U{d}": du, f"W{d}": dw}
        return loss, grads

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Network:
        """Adam on random windows; each label is drawn equally often."""
        rng = np.random.default_rng(seed)
        own = [[np.frombuffer((t * (WINDOW // len(t) + 1) if len(t) < WINDOW else t), np.uint8) for t, y in zip(texts, labels, strict=True) if y == k and t] for k in range(len(self.labels))]
        able = [k for k, o in enumerate(own) if o]
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.choice(able, BATCH)
            x = np.empty((WINDOW, BATCH), np.int64)
            for i, k in enumerate(y):
                t = own[k][rng.integers(len(own[k]))]
                a = rng.integers(len(t) - WINDOW + 1)
                x[:, i] = t[a : a + WINDOW]
            _, grads = self.gradients(x, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = np.float32(min(1.0, 1.0 / max(norm, 1e-6)))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * scale
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[memoryview]) -> np.ndarray:
        """Each text's mean probabilities over the positions of its letters; zeros where there are none."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + bytes(STRETCH), np.uint8)
        begin = np.cumsum(sizes) - sizes
        parts = -(-sizes // STRETCH)
        doc = np.repeat(np.arange(len(texts)), parts)
        at = begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        size = np.minimum(STRETCH, begin[doc] + sizes[doc] - at)
        sums = np.zeros((len(texts), len(self.labels)))
        count = np.zeros(len(texts))
        order = np.argsort(-size, kind="stable")
        lanes = max(64, min(2048, (1 << 21) // (STRETCH * len(self.labels)) * 2))
        for i in range(0, len(order), lanes):
            own = order[i : i + lanes]
            width = int(size[own].max())
            x = data[at[own][:, None] + np.arange(width)]
            on = (IS_LETTER[x] & (np.arange(width) < size[own][:, None])).T
            p = self.label(x, size[own])
            p *= on[:, None, :]
            np.add.at(sums, doc[own], p.sum(axis=0).T)
            np.add.at(count, doc[own], on.sum(axis=0))
        return sums / np.maximum(count, 1)[:, None]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is held out from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network:
    """A network for the languages of the documents that aren't held out.

    Learns from SAMPLE_DOCUMENTS documents of each language at most, chosen by a hash, and of each a stretch of
    SAMPLE_CHARACTERS at a place chosen by a hash; that bounds what the driver gets of each. All languages are
    learned.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    counts = sorted(((r[1], r[0]) for r in rows.groupBy(lang).count().collect()), key=lambda x: (-x[0], x[1]))
    if not counts:
        return Network([])
    chance = F.create_map(*(F.lit(v) for n, k in counts for v in (k, min(1.0, 1.5 * SAMPLE_DOCUMENTS / n))))
    lot = F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit(2)), F.greatest(F.length(text) - SAMPLE_CHARACTERS, F.lit(0)) + 1).cast("int") + 1
    some = rows.withColumn("_lot", lot).filter(F.col("_lot") < chance[F.col(lang)]).select(lang, "_lot", F.substring(F.col(text), place, F.lit(SAMPLE_CHARACTERS)).alias("t")).collect()
    labels = sorted({r[0] for r in some})
    texts: list[bytes] = []
    y: list[int] = []
    for k, label in enumerate(labels):
        own = sorted((r[1], r[2]) for r in some if r[0] == label)[:SAMPLE_DOCUMENTS]
        texts += [t.encode("utf-8", "replace") for _, t in own]
        y += [k] * len(own)
    return Network(labels).fit(texts, y)


NEW = [("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType())]


def identify(docs: DataFrame, network: Network | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs with held_out, lang_pred and score; columns with these names are replaced."""
    network = network or train(docs, text, lang, doc_id)
    docs = without(docs, [n for n, _ in NEW] + ["_letter"])
    fields = docs.schema.fields
    ready = docs.withColumn("held_out", held_out(doc_id)).withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches, text):
            able = b.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if net.labels and able.any():
                own = [v for v, a in zip(views(b.column(text)), able, strict=True) if a]
                place: dict[bytes, int] = {}  # copies of a text are read once
                which = np.array([place.setdefault(bytes(v), len(place)) for v in own])
                p = net.predict([memoryview(v) for v in place])[which]
                pred[able] = np.array(net.labels, object)[p.argmax(axis=1)]
                score[able] = np.clip(p.max(axis=1), 0, 1)
            kept = [c for c in b.schema.names if c != "_letter"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return ready.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in NEW)]))
