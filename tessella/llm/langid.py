"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in stretches of `STRETCH` bytes, one direction from the
front and one from the back, gives every byte position probabilities of the
languages, and pools them over the whole document. It is trained here, in numpy, by
backpropagation through time on stretches of a bounded sample of labelled documents.
Many stretches run side by side, so a step over one byte is a few array operations.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import received, shipped, sliced

STRETCH = 128
HIDDEN = 8
BATCH = 4096
LETTER = re.compile(r"[^\W\d_]")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction. Update and reset gates and candidate lie side by side in w (by
    byte) and u; state: (batch, hidden)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.w = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.w[:, :hidden] -= 0.5
        self.hidden = hidden

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u]

    def forward(self, x: np.ndarray, keep: list | None = None):
        """x: (steps, batch) of bytes, 256 where there is none. Yields the state after
        each step; keep gets what backward needs."""
        k = self.hidden
        h = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x)):
            a = self.w[x[t]]
            b = h @ self.u
            zr = sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, b[:, 2 * k :]))
            h = new
            yield h

    def backward(self, x: np.ndarray, kept: list, grads: np.ndarray) -> list[np.ndarray]:
        """grads: (steps, batch, hidden), of the loss by each state."""
        k = self.hidden
        das, du = np.empty((*x.shape, 3 * k), np.float32), np.zeros_like(self.u)
        dh = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, bn = kept[t]
            dh = dh + grads[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            db = np.concatenate([dz, dr, dn * r], 1)
            das[t] = da
            du += h.T @ db
            dh = dh * z + db @ self.u.T
        flat, das = x.ravel(), das.reshape(-1, 3 * k)
        dw = np.stack([np.bincount(flat, das[:, j], 257) for j in range(3 * k)], 1).astype(np.float32)
        return [dw, du]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.front, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden + 1, len(languages))).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.front.params(), *self.back.params(), self.out]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(steps, batch) bytes to (steps, batch, languages) probabilities."""
        k = self.front.hidden
        score = np.empty((*x.shape, len(self.languages)), np.float32)
        for t, h in enumerate(self.front.forward(x)):
            score[t] = h @ self.out[:k] + self.out[2 * k]
        for t, h in enumerate(self.back.forward(x[::-1])):
            score[len(x) - 1 - t] += h @ self.out[k : 2 * k]
        score -= score.max(-1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(-1, keepdims=True)
        return score

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients; y: the language of each column, asked at every byte."""
        k = self.front.hidden
        kept_f, kept_b = [], []
        hf = np.stack(list(self.front.forward(x, kept_f)))
        hb = np.stack(list(self.back.forward(x[::-1], kept_b)))[::-1]
        both = np.concatenate([hf, hb, np.ones((*x.shape, 1), np.float32)], 2)
        score = both @ self.out
        score -= score.max(-1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(-1, keepdims=True)
        real = (x < 256).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2) + 1e-9)[..., 0] * real).sum()) / total
        p[:, np.arange(len(y)), y] -= 1
        p *= real[..., None] / total
        dout = both.reshape(-1, 2 * k + 1).T @ p.reshape(-1, p.shape[2])
        dh = p @ self.out[: 2 * k].T
        return loss, [*self.front.backward(x, kept_f, dh[..., :k]), *self.back.backward(x[::-1], kept_b, dh[::-1, :, k:]), dout]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 7) -> float:
        """Adam over shuffled batches of stretches; x: (stretches, STRETCH)."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        done, loss, total = 0, 0.0, epochs * (-(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                loss, grads = self.step(np.ascontiguousarray(x[pick].T), y[pick])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                done += 1
                lr = rate * (1 - done / (total + 1))
                for p, g, a, b in zip(params, grads, m, v):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (lr * (a / (1 - 0.9**done)) / (np.sqrt(b / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
        return loss


def stretches(text: bytes) -> np.ndarray:
    """(n, STRETCH) of bytes, filled up with 256."""
    n = -(-len(text) // STRETCH)
    out = np.full(n * STRETCH, 256, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, STRETCH)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; texts aren't empty."""
    total = np.zeros((len(texts), len(net.languages)), np.float64)
    rows, owner, size = [], [], 0

    def flush():
        x = np.concatenate(rows)
        of = np.repeat([o for o, _ in owner], [n for _, n in owner])
        for i in range(0, len(x), BATCH):
            part = np.ascontiguousarray(x[i : i + BATCH].T)
            p = net.positions(part)
            p *= (part < 256)[..., None]
            np.add.at(total, of[i : i + BATCH], p.sum(0))

    for i, text in enumerate(texts):
        s = stretches(text)
        rows.append(s)
        owner.append((i, len(s)))
        size += len(s)
        if size >= BATCH:
            flush()
            rows, owner, size = [], [], 0
    if size:
        flush()
    return total / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = 600, per_doc: int = 4, epochs: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learns from at most `sample` documents for each language, those with the smallest
    hash of id and text, and from up to `per_doc` stretches spread over the text of each.
    Only documents with text and a language that aren't held out take part; repeated
    rows count once; every language is learned. None if there are none. What comes to
    the driver is `sample` rows of per_doc stretches for each language."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("doc_id", "text"))
    # Enough by hash to hold the smallest `sample` of each language, each once.
    shares = {r.lang: 2.0 * sample / r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = F.from_json(F.lit(json.dumps(shares)), "map<string,double>")[F.col("lang")]
    cut = F.transform(F.sequence(F.lit(0), F.lit(per_doc - 1)), lambda i: F.substring(F.col("text"), (i * F.length("text") / per_doc).cast("int") + 1, F.lit(STRETCH)))
    some = known.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("lang", F.pmod("h", F.lit(1 << 20)).alias("p"), "h", cut.alias("cut")).dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("p", "h")
    rows = some.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= sample).select("lang", "turn", "cut").collect()
    x, y, languages = [], [], sorted({r.lang for r in rows})
    for r in sorted(rows, key=lambda r: (r.turn, r.lang)):
        for s in dict.fromkeys(r.cut):
            if s.strip():
                x.append(stretches(s.encode()[:STRETCH])[0])
                y.append(languages.index(r.lang))
    if not x:
        return None
    # Languages count alike: rare ones are repeated.
    y = np.array(y)
    most = np.bincount(y, minlength=len(languages)).max()
    rng = np.random.default_rng(3)
    pick = np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == c)), min(most, 3 * int((y == c).sum()))) for c in range(len(languages)) if (y == c).any()])
    net = Network(languages)
    net.train(np.stack(x)[pick], y[pick], epochs)
    return net


def lettered(batches):
    """The rows whose text has a letter."""
    for batch in sliced(batches):
        ok = [bool(t and LETTER.search(t)) for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(ok, pa.bool_()))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id as doc_id, the columns named in keep, lang_pred and score (the pooled
    probability). A text that is null or has no letter, and any text if there was
    nothing to learn from, is 'und' with score 0. Whole texts are read; repeated rows
    get the same answer; no rows for no documents."""
    if clash := {"doc_id", "_text", "lang_pred", "score"} & set(keep):
        raise ValueError(f"kept columns would clash with the result's: {sorted(clash)}")
    shared = shipped(docs.sparkSession, net)
    held = text_col in keep
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, *([] if held else [F.col(text_col).alias("_text")]))

    def label(batches):
        net = received(shared)
        for batch in sliced(batches):
            got = batch.column(text_col if held else "_text").to_pylist()
            at = [i for i, t in enumerate(got) if net is not None and t and LETTER.search(t)]
            lang, score = ["und"] * len(got), [0.0] * len(got)
            p = pooled(net, [got[i].encode() for i in at]) if at else ()
            for i, row in zip(at, p):
                best = int(np.argmax(row))
                lang[i], score[i] = net.languages[best], min(1.0, float(row[best]))
            names = ["doc_id", *keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep))
    return rows.mapInArrow(label, f"{kinds}lang_pred string, score double")
