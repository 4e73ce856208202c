"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions with gated
recurrent units, gives every position a distribution over the languages, and a
text the mean of its positions' distributions. It is trained here, in numpy, by
backpropagation through time with every position of a training window labelled
with its document's language.

Training data are a bounded sample (``docs_per_lang`` documents of each language,
one slice of at most ``slice_chars`` characters of each; both are parameters).
Prediction covers every byte of every text: texts are cut into segments of equal
length that run through the network side by side as columns of one matrix, so a
task's memory is bounded whatever the length of a text; a segment begins without
context. A long text is segments like any others.

Defined results: null text, or one without a letter, is ``und`` with score 0;
null languages are not learned from but predicted; without any labelled document
all texts are ``und``; repeated rows are predicted each; an empty table gives no
rows; a null id counts as the empty text for the fold; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.llm import words as W
from answerlab.llm.common import own_names
from answerlab.session import ship_package

UNKNOWN = "und"
_STEPS, _LANES = 64, 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Weights by direction (0 forward, 1 backward): ``x`` byte to the three
    gates' inputs (256, 3H), ``u`` state to update and reset gates (H, 2H), ``c``
    gated state to candidate (H, H); ``v`` states to languages (2H, L), ``b``."""

    def __init__(self, hidden: int, languages: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.w = hidden, {}
        for d in (0, 1):
            self.w |= {f"x{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": rng.normal(0, 0.3, (hidden, 2 * hidden)),
                       f"c{d}": rng.normal(0, 0.3, (hidden, hidden))}
        self.w |= {"v": rng.normal(0, 0.3, (2 * hidden, languages)), "b": np.zeros(languages)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    # Training: rows are windows.
    def _run(self, d: int, x: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Per time step (input order): state before, gates z and r, candidate, state."""
        n, k = x.shape[0], self.hidden
        h, trace = np.zeros((n, k), np.float32), [None] * x.shape[1]
        for t in (range(x.shape[1]) if d == 0 else reversed(range(x.shape[1]))):
            a = self.w[f"x{d}"][x[:, t]]
            g = _sigmoid(a[:, :2 * k] + h @ self.w[f"u{d}"])
            z, r = g[:, :k], g[:, k:]
            c = np.tanh(a[:, 2 * k:] + (r * h) @ self.w[f"c{d}"])
            new = h + z * (c - h)
            trace[t] = (h, z, r, c, new)
            h = new
        return trace

    def _back(self, d: int, x: np.ndarray, trace: list, out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Backpropagation through time; ``out``: loss by state, (windows, steps, H)."""
        k, u, c_w = self.hidden, self.w[f"u{d}"], self.w[f"c{d}"]
        flow = np.zeros_like(trace[0][0])
        for t in (reversed(range(x.shape[1])) if d == 0 else range(x.shape[1])):
            h, z, r, c, _ = trace[t]
            dh = flow + out[:, t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            gated = dc @ c_w.T
            dr = gated * h * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            grads[f"c{d}"] += (r * h).T @ dc
            grads[f"u{d}"] += h.T @ dg
            np.add.at(grads[f"x{d}"], x[:, t], np.concatenate([dg, dc], axis=1))
            flow = dh * (1 - z) + gated * r + dg @ u.T

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch; every position is labelled y."""
        traces = [self._run(d, x) for d in (0, 1)]
        states = np.concatenate([np.stack([s[4] for s in trace], axis=1) for trace in traces], axis=2)
        p = self._softmax(states @ self.w["v"] + self.w["b"])
        count = x.size
        loss = float(-np.log(p[np.arange(len(y))[:, None], np.arange(x.shape[1])[None, :], y[:, None]] + 1e-9).mean())
        p[np.arange(len(y))[:, None], np.arange(x.shape[1])[None, :], y[:, None]] -= 1
        p /= count
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["v"] = np.tensordot(states, p, axes=([0, 1], [0, 1]))
        grads["b"] = p.sum(axis=(0, 1))
        back = p @ self.w["v"].T
        for d in (0, 1):
            self._back(d, x, traces[d], back[:, :, d * self.hidden:(d + 1) * self.hidden], grads)
        return loss, grads

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        return a / a.sum(axis=-1, keepdims=True)

    # Prediction: columns are segments, so that each gate's rows are contiguous.
    def label(self, x: np.ndarray) -> np.ndarray:
        """Distributions (steps, languages, segments) of byte columns (steps, segments)."""
        k, n = self.hidden, x.shape[1]
        out = np.empty((x.shape[0], len(self.w["b"]), n), np.float32)
        out[:] = self.w["b"][:, None]
        for d in (0, 1):
            table, u = np.ascontiguousarray(self.w[f"x{d}"].T), np.ascontiguousarray(self.w[f"u{d}"].T)
            table[:2 * k] *= 0.5  # sigmoid(a) = 0.5 tanh(a / 2) + 0.5
            u *= 0.5
            c_w, v = np.ascontiguousarray(self.w[f"c{d}"].T), np.ascontiguousarray(self.w["v"][d * k:(d + 1) * k].T)
            h, a = np.zeros((k, n), np.float32), np.empty((3 * k, n), np.float32)
            for t in (range(x.shape[0]) if d == 0 else reversed(range(x.shape[0]))):
                np.take(table, x[t], axis=1, out=a, mode="clip")
                g = a[:2 * k]
                g += u @ h
                np.tanh(g, out=g)
                g += 1
                g *= 0.5
                c = a[2 * k:]
                c += c_w @ (g[k:] * h)
                np.tanh(c, out=c)
                c -= h
                c *= g[:k]
                h += c
                out[t] += v @ h
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out


def train(samples: list[tuple[str, str]], hidden: int = 8, steps: int = 48, batch: int = 128, rounds: int = 300,
          rate: float = 0.02, seed: int = 7) -> tuple[ByteGru, list[str]] | None:
    """Fit by Adam on random windows of (text, language) samples, the languages
    in equal parts. None without samples."""
    by: dict[str, list[np.ndarray]] = {}
    for text, lang in sorted(samples):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data):
            by.setdefault(lang, []).append(np.pad(data, (0, max(0, steps - len(data))), constant_values=0x20))
    languages = sorted(by)
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net = ByteGru(hidden, len(languages), seed)
    one, two = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        y = rng.integers(0, len(languages), batch)
        texts = [by[languages[c]][rng.integers(0, len(by[languages[c]]))] for c in y]
        at = [rng.integers(0, len(t) - steps + 1) for t in texts]
        x = np.stack([t[a:a + steps] for t, a in zip(texts, at)])
        _, grads = net.step(x, y)
        now = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - now * (one[k] / (1 - 0.9 ** i)) / (np.sqrt(two[k] / (1 - 0.99 ** i)) + 1e-6)).astype(np.float32)
    return net, languages


def pooled(net: ByteGru, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean distribution over the positions of every text."""
    size = np.diff(at)
    each = -(-size // _STEPS)
    doc = np.repeat(np.arange(len(size)), each)
    start = at[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * _STEPS
    length = np.minimum(_STEPS, at[1:][doc] - start)
    sums = np.zeros((len(size), len(net.w["b"])))
    padded = np.concatenate([data, np.full(_STEPS, 0x20, np.uint8)])
    step = np.arange(_STEPS)[:, None]
    for i in range(0, len(doc), _LANES):
        lanes = slice(i, i + _LANES)
        real = step < length[lanes]
        x = np.where(real, padded[start[lanes] + step], 0x20)
        p = net.label(x)
        p *= real[:, None, :]
        np.add.at(sums, doc[lanes], p.sum(axis=0).T)
    return sums / np.maximum(size, 1)[:, None]


def _has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[65:91] = ascii_letter[97:123] = 1
    total = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    found = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[at[i]:at[i + 1]].tobytes().decode())
    return found


def _predict(net: ByteGru | None, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_bytes(batch.column("text"))
            named, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if net is not None and len(batch):
                p, letter = pooled(net, data, at), _has_letter(data, at)
                best = p.argmax(axis=1)
                named = [languages[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                score = np.where(letter, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def held_out(ident: Column) -> Column:
    """Fold of the contract: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, docs_per_lang: int, slice_chars: int) -> list[tuple[str, str]]:
    """At most ``docs_per_lang`` slices for each language from the learning
    fold, picked by a hash of the id and text."""
    known = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * docs_per_lang / r["count"]))])
    mark = F.xxhash64("doc_id", "text")
    picked = (known.withColumn("_u", F.pmod(mark, F.lit(1_000_003)) / 1_000_003.0)
              .where(F.col("_u") < share[F.col("lang")])
              .withColumn("_at", F.pmod(mark, F.greatest(F.char_length("text") - slice_chars + 1, F.lit(1))))
              .select("_u", F.substring(F.col("text"), F.col("_at").cast("int") + 1, F.lit(slice_chars)).alias("text"), "lang"))
    taken: dict[str, int] = {}
    out = []
    for r in sorted(picked.collect(), key=lambda r: (r["_u"], r["text"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= docs_per_lang:
            out.append((r["text"], r["lang"]))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 400,
             slice_chars: int = 512) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col}).withColumn("held_out", held_out(F.col("doc_id")))
    fitted = train(sample(own, docs_per_lang, slice_chars))
    net, languages = fitted if fitted else (None, [])
    kind = own.schema["doc_id"].dataType.simpleString()
    return (own.select("doc_id", "held_out", "text")
            .mapInArrow(_predict(net, languages), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
            .toDF(id_col, "held_out", "lang_pred", "score"))
