"""Secret scans: fixed rules, and a character convolutional network over every candidate.

Rules (``base_spans``) find assignments to secret-like names, access key ids and
long hexadecimal runs. They know three formats only. Everything else goes to a
network: every *candidate*, a maximal run of ``[A-Za-z0-9+/_.-]`` (with up to two
``=`` behind it) of at least 8 bytes that holds a digit or one of ``+/_``, or that
stands behind ``:`` or ``=``, is read together with the text around it. What the
network finds is added to what the rules find; a rule's span always stays.

The network embeds every byte with a mark for "inside the candidate", convolves
five positions at a time, pools by maximum and mean, and ends in one hidden
layer. It is written, and trained by backpropagation, in numpy here. A candidate
of any length is read whole, 32 bytes and their surroundings at a time; its score
is the highest of its windows.

Training data are labelled findings: (context before, candidate, context after,
is it a secret). The query takes them from two places. Every different candidate
of all documents is one, labelled by the rules: spans of the rules are secrets,
all other candidates are not. ``generated_findings`` gives as many again, in
formats the rules do not know and among the words that stand around the
candidates, labelled by how they were made. A third of the findings is held out
from training; on all of it a logistic calibration turns scores into
probabilities, and for each class of candidates (assigned, bare) the threshold is
the highest one that keeps ``recall`` of the held-out secrets.

Findings are dealt into parts of about ``_PART`` windows by a hash. In each of
some rounds a part goes on from the common weights through all of its findings,
and the mean of the parts' weights, weighted by their windows, is common to the
next round. Scores are steps of 1 / ``_GRID``, so that calibration and thresholds
over all parts need counts of score values only.

Defined results: null and empty texts have no spans; offsets are code points;
spans are ordered by start, then kind; a network span that touches a rule's span
is left out (the secret is found already); repeated rows are scanned each; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import words as W
from answerlab.llm.common import own_names
from answerlab.session import cut_lineage, ship_package

# Fixed values of the contract: kinds in order, patterns, least sizes.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RULES = ((re.compile(_ASSIGN, re.I | re.A), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))

_SLICE = 4 << 20
#: Windows of the documents in one part of the training data; steps of a score, and its largest size.
_PART, _GRID, _FAR = 4096, 256, 40
_LEAST = 8
_BEFORE, _PIECE, _AFTER = 24, 32, 16
_WIDTH = _BEFORE + _PIECE + _AFTER

_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-"]] = True
_TELLING = np.zeros(256, bool)
_TELLING[[*range(48, 58), *b"+/_"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True

Finding = tuple[bytes, bytes, bytes, int]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rules' spans, in code points."""
    out = []
    for kind, (pattern, group, least) in enumerate(_RULES):
        if kind == 2:  # runs of this length only: most runs are one letter of a word
            pattern = re.compile("[0-9a-f]{%d,}" % least)
        out += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes within single texts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def candidates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, assigned) of every candidate; offsets in ``data``."""
    if not len(data):
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool))
    start, end = _runs(_CLASS[data], at)
    longer = end - start >= _LEAST
    start, end = start[longer], end[longer]
    text = np.searchsorted(at, start, side="right") - 1
    telling = np.concatenate(([0], np.cumsum(_TELLING[data], dtype=np.int32)))
    begin, stop = at[text], at[text + 1]
    back = start - 1
    for _ in range(3):  # over a quote and blanks
        back -= (back >= begin) & np.isin(data[np.maximum(back, 0)], list(b"\"' "))
    assigned = (back >= begin) & np.isin(data[np.maximum(back, 0)], list(b":="))
    keep = assigned | (telling[end] > telling[start])
    text, start, end, stop, assigned = text[keep], start[keep], end[keep], stop[keep], assigned[keep]
    for _ in range(2):  # padding
        end += (end < stop) & (data[np.minimum(end, len(data) - 1)] == 0x3D)
    return text, start, end, assigned


def windows(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, cells): windows of candidates [start, end) in texts [begin,
    stop); a cell is byte + 256 x inside the candidate, and 0 beyond the text."""
    each = np.maximum(1, -(-(end - start) // _PIECE))
    of = np.repeat(np.arange(len(start)), each)
    first = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * _PIECE
    place = first[:, None] + np.arange(-_BEFORE, _PIECE + _AFTER)[None, :]
    real = (place >= begin[of][:, None]) & (place < stop[of][:, None])
    cells = data[np.clip(place, 0, max(0, len(data) - 1))].astype(np.int64) if len(data) else np.zeros(place.shape, np.int64)
    cells += 256 * ((place >= start[of][:, None]) & (place < end[of][:, None]))
    return of, np.where(real, cells, 0)


class CharCnn:
    """Weights: ``e`` embedding (512, D), ``c`` convolution (5 D, K) and ``cb``,
    ``h`` pooled features to the hidden layer (2 K, H) and ``hb``, ``o`` (H,), ``ob``."""

    SPAN, DEPTH, FILTERS, HIDDEN = 5, 8, 24, 16

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        shapes = {"e": ((512, self.DEPTH), 0.5), "c": ((self.SPAN * self.DEPTH, self.FILTERS), 0.2), "cb": ((self.FILTERS,), 0.0),
                  "h": ((2 * self.FILTERS, self.HIDDEN), 0.2), "hb": ((self.HIDDEN,), 0.0), "o": ((self.HIDDEN,), 0.2), "ob": ((1,), 0.0)}
        self.w = {k: rng.normal(0, s, shape).astype(np.float32) if s else np.zeros(shape, np.float32) for k, (shape, s) in shapes.items()}

    def _forward(self, cells: np.ndarray) -> dict[str, np.ndarray]:
        w, steps = self.w, cells.shape[1] - self.SPAN + 1
        x = w["e"][cells]
        u = np.concatenate([x[:, i:i + steps] for i in range(self.SPAN)], axis=2)
        a = np.maximum(u @ w["c"] + w["cb"], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], axis=1)[:, 0], a.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["h"] + w["hb"], 0)
        return {"u": u, "a": a, "top": top, "pooled": pooled, "hidden": hidden, "score": hidden @ w["o"] + w["ob"][0]}

    def score(self, cells: np.ndarray) -> np.ndarray:
        """Log-odds of every window."""
        return np.concatenate([self._forward(cells[i:i + 1024])["score"] for i in range(0, len(cells), 1024)] or [np.zeros(0, np.float32)])

    def step(self, cells: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss and its gradients."""
        w, t = self.w, self._forward(cells)
        n, steps, k = len(y), t["a"].shape[1], self.FILTERS
        loss = float(np.mean(np.logaddexp(0, t["score"]) - y * t["score"]))
        d = ((1 / (1 + np.exp(-t["score"])) - y) / n).astype(np.float32)
        dh = (d[:, None] * w["o"]) * (t["hidden"] > 0)
        dp = dh @ w["h"].T
        da = np.repeat(dp[:, None, k:] / steps, steps, axis=1)
        da[np.arange(n)[:, None], t["top"], np.arange(k)[None, :]] += dp[:, :k]
        da *= t["a"] > 0
        du = da @ w["c"].T
        grads = {"o": t["hidden"].T @ d, "ob": d.sum(keepdims=True), "h": t["pooled"].T @ dh, "hb": dh.sum(axis=0),
                 "c": np.tensordot(t["u"], da, axes=([0, 1], [0, 1])), "cb": da.sum(axis=(0, 1))}
        dx = np.zeros((*cells.shape, self.DEPTH), du.dtype)
        for i in range(self.SPAN):
            dx[:, i:i + steps] += du[:, :, i * self.DEPTH:(i + 1) * self.DEPTH]
        grads["e"] = np.stack([np.bincount(cells.reshape(-1), dx[:, :, i].reshape(-1), 512) for i in range(self.DEPTH)], axis=1).astype(w["e"].dtype)
        return loss, grads

    def descend(self, cells: np.ndarray, y: np.ndarray, least: int, batch: int, rate: float, seed: int, part: tuple[float, float] = (0.0, 1.0)) -> None:
        """Adam steps over batches of as many secrets as others. Every window is in a
        step: the larger class is walked through once, in ``least`` steps or more; the
        rate falls over the ``part`` of the training that this is."""
        pools = [np.flatnonzero(y == c) for c in (0, 1)]
        if not all(map(len, pools)):
            return
        half, rng = batch // 2, np.random.default_rng(seed)
        steps = max(least, -(-max(map(len, pools)) // half))
        order = [np.concatenate([rng.permutation(p) for _ in range(-(-steps * half // len(p)))]) for p in pools]
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for i in range(1, steps + 1):
            at = np.concatenate([o[(i - 1) * half:i * half] for o in order])
            _, grads = self.step(cells[at], y[at])
            now = rate * min(1.0, 2 * (1 - part[0] - (part[1] - part[0]) * i / (steps + 1)))
            for k, g in grads.items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (one[k] / (1 - 0.9 ** i)) / (np.sqrt(two[k] / (1 - 0.99 ** i)) + 1e-7)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].reshape(-1) for k in sorted(self.w)])

    def set_flat(self, values: np.ndarray) -> None:
        at = np.cumsum([0, *(self.w[k].size for k in sorted(self.w))])
        self.w = {k: np.asarray(values[i:j], np.float32).reshape(self.w[k].shape) for k, i, j in zip(sorted(self.w), at, at[1:])}


@dataclass
class Model:
    """A trained network with its calibration (slope, shift) and the thresholds
    of bare and of assigned candidates."""
    net: CharCnn
    slope: float
    shift: float
    thresholds: tuple[float, float]

    def probability(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Calibrated probability of every candidate [start, end) in its text [begin, stop)."""
        best = np.full(len(start), -np.inf)
        for i in range(0, len(start), 4096):
            of, cells = windows(data, *(x[i:i + 4096] for x in (begin, stop, start, end)))
            np.maximum.at(best, of + i, self.net.score(cells))
        return self.calibrated(_steps(best) / _GRID)

    def calibrated(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


def _steps(score: np.ndarray) -> np.ndarray:
    """Scores (log-odds) in whole steps."""
    return np.floor(np.clip(score, -_FAR, _FAR) * _GRID).astype(np.int64)


def _laid_out(findings: list[Finding]) -> tuple[np.ndarray, ...]:
    """(data, begin, stop, start, end) of findings one behind another."""
    size = np.array([[len(x) for x in f[:3]] for f in findings], np.int64).reshape(-1, 3)
    stop = np.cumsum(size.sum(axis=1))
    begin = stop - size.sum(axis=1)
    return np.frombuffer(b"".join(b"".join(f[:3]) for f in findings), np.uint8), begin, stop, begin + size[:, 0], stop - size[:, 2]


def _is_assigned(before: bytes) -> bool:
    return re.search(rb"[:=][\"' ]{0,3}$", before) is not None


class _Findings:
    """Findings as windows: which finding each is ``of``, its ``cells``; by finding
    the label ``y``, whether it is assigned, and whether it is held out."""

    def __init__(self, findings: Iterable[Finding]):
        findings = sorted(set(findings))
        self.fold = np.array([hashlib.sha256(b"\0".join(f[:3])).digest()[0] % 3 == 0 for f in findings], bool)
        self.y = np.array([f[3] for f in findings], np.float32)
        self.assigned = np.array([_is_assigned(f[0]) for f in findings], bool)
        data, *spans = _laid_out(findings)
        self.of, self.cells = windows(data, *spans)

    def train(self, net: CharCnn, *how) -> int:
        """Train on what is not held out; how many windows that is."""
        own = np.flatnonzero(~self.fold[self.of])
        net.descend(self.cells[own], self.y[self.of[own]], *how)
        return len(own)

    def held(self, net: CharCnn) -> np.ndarray:
        """(score in steps, is a secret, is assigned, how many) of what is held out."""
        own = np.flatnonzero(self.fold[self.of])
        best = np.full(len(self.fold), -np.inf)
        np.maximum.at(best, self.of[own], net.score(self.cells[own]))
        rows = np.stack([_steps(best[self.fold]), self.y[self.fold].astype(np.int64), self.assigned[self.fold].astype(np.int64)], axis=1)
        rows, count = np.unique(rows, axis=0, return_counts=True)
        return np.concatenate([rows, count[:, None]], axis=1)


def fit(findings: Iterable[Finding], recall: float = 0.98, rounds: int = 500, batch: int = 96, rate: float = 0.004, seed: int = 5) -> Model:
    """Train on two thirds of the findings (context before, candidate, context
    after, 1 if a secret), ``rounds`` steps at least; calibrate and set thresholds on the others."""
    own, net = _Findings(findings), CharCnn(seed)
    own.train(net, rounds, batch, rate, seed)
    return _fitted(net, own.held(net), recall)


def _fitted(net: CharCnn, held: np.ndarray, recall: float) -> Model:
    """The model of a network, from the counts of its held-out scores (rows of :meth:`_Findings.held`)."""
    held = held[np.argsort(held[:, 0], kind="stable")]
    score, y, assigned, count = held[:, 0] / _GRID, *held[:, 1:].T
    model = Model(net, *_calibrated(score, y, count), (1.1, 1.1))
    limits = []
    for kind in (0, 1):
        own = (y == 1) & (assigned == kind)
        upto = np.cumsum(count[own])
        # the highest threshold that keeps the recall; never below even odds
        limits.append(max(0.5, float(model.calibrated(score[own][np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]))) if len(upto) else 1.1)
    model.thresholds = tuple(limits)
    return model


def _calibrated(score: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, with softened targets; ``count`` findings have a score and label."""
    pos, neg = float(count[y > 0].sum()), float(count[y <= 0].sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.stack([score, np.ones_like(score)], axis=1).astype(float), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (count * (p - target)) + 1e-3 * (w - [1.0, 0.0])), -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def generated_findings(words: list[str], count: int = 1500, seed: int = 11) -> list[Finding]:
    """Labelled findings among the given words and invented ones: random keys in common shapes are
    secrets; addresses, names, dates, numbers and place holders are not."""
    rnd = random.Random(seed)
    syllables = [c + v + e for c in "bcdfghlmnprstvw" for v in "aeiou" for e in ("", "n", "r", "s", "t")]
    words = sorted(set(words)) + ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(600)]
    alnum, hexa, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits

    def some(chars: str, low: int, high: int | None = None) -> str:
        return "".join(rnd.choice(chars) for _ in range(rnd.randint(low, high or low)))

    def word() -> str:
        return re.sub("[^a-z]", "", rnd.choice(words).lower()) or "item"

    secrets = [lambda: some(alnum, 24, 64), lambda: some(alnum + "+/", 40), lambda: some(hexa, 16, 64), lambda: some(upper, 18, 32),
               lambda: "eyJ" + some(alnum, 20) + "." + some(alnum + "-_", 30, 60) + "." + some(alnum + "-_", 43),
               lambda: word()[:4] + rnd.choice("_-") + some(alnum, 20, 40), lambda: some(alnum + "+/", 42) + "==",
               lambda: word()[:3] + "_live_" + some(alnum, 24), lambda: some(string.digits, 10, 12) + "-" + some(alnum, 24, 32)]
    mixed = [lambda: some(alnum, 10, 20), lambda: some(alnum + "_+/", 12, 24), lambda: some(hexa, 10, 40)]
    harmless = [lambda: f"{word()}.{rnd.randint(1, 99)}", lambda: f"mail{rnd.randint(1, 9)}.{word()}.com", lambda: some(string.digits, 8, 19),
                lambda: f"20{rnd.randint(10, 29)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", lambda: f"{word()}_{word()}_{rnd.randint(1, 999)}",
                lambda: f"{word()}/{word()}/{word()}.{rnd.choice(['png', 'html', 'py', 'csv'])}", lambda: f"{word()}-{word()}-{rnd.randint(1, 99)}",
                lambda: f"v{rnd.randint(1, 9)}.{rnd.randint(10, 99)}.{rnd.randint(100, 999)}", lambda: f"{word().upper()[:6]}-{some(string.digits, 4, 8)}",
                lambda: rnd.choice("x0*#a-") * rnd.randint(8, 30) + "1", lambda: f"{word()}{word().capitalize()}{rnd.randint(1, 99)}",
                lambda: f"www.{word()}.org/{word()}", lambda: "+" + some(string.digits, 9, 13), lambda: f"{word()}_{word()}"]
    plain = [lambda: word() + word() + word()[:4], lambda: f"{word()}_{word()}_name", lambda: some(string.digits, 8, 10), lambda: f"{word()}.{word()}.com"]
    names = ["pwd", "pass", "auth", "key", "secret_key", "access", "credential", "private", "bearer", "client_secret"]
    other = ["name", "id", "path", "title", "date", "page", "url", "file", "note", "size"]
    out = []
    for i in range(count):
        mode = rnd.random()
        mark = rnd.choice([":", "=", ": ", " = ", '="', ": '"])
        if mode < 0.30:
            lead, value, label = " ", rnd.choice(secrets)(), 1
        elif mode < 0.50:
            lead, value, label = " " + rnd.choice(names) + mark, rnd.choice(secrets + mixed)(), 1
        elif mode < 0.85:
            lead, value, label = rnd.choice([" ", " ", " (", "\n"]), rnd.choice(harmless)(), 0
        else:
            lead, value, label = " " + rnd.choice(other + [word()]) + mark, rnd.choice(plain + harmless)(), 0
        value = value if len(value) >= _LEAST else value + "_" * 1 + word() + word()
        before = " ".join(rnd.choice(words) for _ in range(6)) + lead
        after = rnd.choice([" ", "\n", ". ", ", ", '" ', ") "]) + " ".join(rnd.choice(words) for _ in range(4))
        out.append((before.encode()[-_BEFORE:], value.encode(), after.encode()[:_AFTER], label))
    return out


def _flagged(column: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts that may hold a span of a rule (a superset)."""
    out = pc.fill_null(pc.or_(pc.match_substring_regex(column, pattern="(?i)" + _ASSIGN), pc.match_substring(column, "AKIA")), False)
    out = np.array(out.to_numpy(zero_copy_only=False))
    if len(data):
        start, end = _runs(_HEX[data], at)
        out[np.searchsorted(at, start[end - start >= 24], side="right") - 1] = True
    return out


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        yield i, j
        i = j


def _touching(spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of [start, end) meet one of the spans (ordered by start)."""
    if not spans:
        return np.zeros(len(start), bool)
    first, furthest = np.array([s[1] for s in spans]), np.maximum.accumulate([s[2] for s in spans])
    at = np.searchsorted(first, end)
    return (at > 0) & (furthest[np.maximum(at, 1) - 1] > start)


def _scan_texts(column: pa.Array, model: Model | None) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, float]], list]]:
    """For each text: the rules' spans, the network's spans with probability, and
    all candidates (start, end, text bytes, byte offsets); offsets in code points."""
    whole, at = W.text_bytes(column)
    for i, j in _slices(at):
        data, own, part = whole[at[i]:at[j]], at[i:j + 1] - at[i], column.slice(i, j - i)
        maybe = _flagged(part, data, own)
        text, start, end, assigned = candidates(data, own)
        wanted = np.zeros(len(text), bool)
        p = np.zeros(len(text))
        if model is not None and len(text):
            p = model.probability(data, own[text], own[text + 1], start, end)
            wanted = p >= np.where(assigned, model.thresholds[1], model.thresholds[0])
        else:
            wanted[:] = True
        bounds = np.searchsorted(text, np.arange(j - i + 1))
        for k in range(j - i):
            rules = base_spans(part[k].as_py() or "") if maybe[k] else []
            mine = np.arange(bounds[k], bounds[k + 1])[wanted[bounds[k]:bounds[k + 1]]]
            if not len(mine):
                yield rules, [], []
                continue
            points = np.concatenate(([0], np.cumsum((data[own[k]:own[k + 1]] & 0xC0) != 0x80)))
            s, e = points[start[mine] - own[k]], points[end[mine] - own[k]]
            touch = _touching(rules, s, e)
            yield (rules, [(int(x), int(y), float(z)) for x, y, z, t in zip(s, e, p[mine], touch) if not t],
                   [(data[max(own[k], a - _BEFORE):a].tobytes(), data[a:b].tobytes(), data[b:min(b + _AFTER, own[k + 1])].tobytes(), int(t))
                    for a, b, t in zip(start[mine], end[mine], touch)] if model is None else [])


_FINDING = pa.schema([("before", pa.binary()), ("value", pa.binary()), ("after", pa.binary()), ("label", pa.int32())])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All different candidates of a batch's texts, labelled by the rules."""
    for batch in batches:
        found = sorted({f for _, _, own in _scan_texts(batch.column("text"), None) for f in own})
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * 4, _FINDING)], schema=_FINDING)


def labelled_findings(docs: DataFrame) -> tuple[DataFrame, int]:
    """``part, before, value, after, label``: every different candidate of all
    documents, labelled by the rules, dealt into parts; and how many parts there
    are. A row labelled -1 begins each part. ``docs`` has ``text``."""
    found = cut_lineage(docs.where("text is not null").mapInArrow(_labelled, "before binary, value binary, after binary, label int").distinct())
    total = found.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.length("value") / F.lit(_PIECE))))).first()[0] or 0
    parts = max(1, -(-int(total) // _PART))
    dealt = found.select(F.pmod(F.xxhash64("before", "value", "after"), F.lit(parts)).cast("int").alias("part"), *_FINDING.names)
    none = F.lit(b"").cast("binary")
    heads = docs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), none.alias("before"), none.alias("value"), none.alias("after"),
                                                  F.lit(-1).alias("label"))
    return cut_lineage(dealt.unionByName(heads)), parts


def _part_findings(table: pa.Table, parts: int, generated: int) -> list[Finding]:
    """A part's findings, and as many generated among the words around them, at
    least the part's share of ``generated``."""
    own = sorted(r for r in zip(*(table.column(c).to_pylist() for c in _FINDING.names)) if r[3] >= 0)
    words = {w for f in own for w in (f[0] + b" " + f[2]).decode(errors="ignore").split() if w.strip(".,;!?()\"'").isalpha()}
    return own + generated_findings(sorted(words), max(len(own), -(-generated // parts)), 11 + table.column("part")[0].as_py())


def learn(docs: DataFrame, recall: float = 0.98, rounds: int = 4, steps: int = 125, batch: int = 96, rate: float = 0.004, seed: int = 5,
          generated: int = 3000) -> Model:
    """The model of all findings of ``docs`` (it has ``text``) and of as many
    generated ones, at least ``generated``: in each of ``rounds`` every part takes
    ``steps`` steps or, if it is larger, one for each batch of its findings."""
    rows, parts = labelled_findings(docs)
    each = rows.repartition(2 * parts, "part").groupBy("part")  # small rows, long work: not to be put together
    net = CharCnn(seed)

    def tuned(turn: int, weights: np.ndarray):
        def run(table: pa.Table) -> pa.Table:
            mine = CharCnn(seed)
            mine.set_flat(weights)
            n = _Findings(_part_findings(table, parts, generated)).train(mine, steps, batch, rate, seed + turn, (turn / rounds, (turn + 1) / rounds))
            return pa.table({"n": pa.array([float(n)]), "w": pa.array([mine.flat().astype(float)], pa.list_(pa.float64()))})
        return run

    def scored(weights: np.ndarray):
        def run(table: pa.Table) -> pa.Table:
            mine = CharCnn(seed)
            mine.set_flat(weights)
            return pa.table(dict(zip(("score", "label", "assigned", "n"), _Findings(_part_findings(table, parts, generated)).held(mine).T)))
        return run

    for turn in range(rounds):
        new = each.applyInArrow(tuned(turn, net.flat()), "n double, w array<double>")
        # one row; rounded, so that the order of the sum does not show
        net.set_flat(np.round(new.agg(Summarizer.mean(array_to_vector("w"), F.col("n")).alias("w")).first()["w"].toArray(), 9))
    held = each.applyInArrow(scored(net.flat()), "score long, label long, assigned long, n long")
    held = held.groupBy("score", "label", "assigned").agg(F.sum("n").alias("n")).collect()  # bounded by the number of score values
    return _fitted(net, np.array([tuple(r) for r in held], np.int64).reshape(-1, 4), recall)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: array of (kind, start, end, score), ordered by start and
    kind; the score is 1 for rules, and the calibrated probability else."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    kind = own.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rules, more, _ in _scan_texts(batch.column("text"), model):
                spans = sorted([(s, k, e, 1.0) for k, s, e in rules] + [(s, 3, e, p) for s, e, p in more])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return own.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start bigint, end bigint, score double>>").withColumnRenamed("doc_id", id_col)


def digest(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the rules' spans, a hash of them, and all spans as text; without
    a model, one is learned from all documents first."""
    ship_package(docs.sparkSession)
    model = model or learn(own_names(docs, {"text": text_col}).withColumn("text", F.col("text").cast("string")))
    found = scan(docs, model, id_col, text_col)

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rules = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        id_col, *[number(kind) for kind in KINDS[:3]],
        F.sha2(shown(rules), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets; of
    overlapping spans, the first one's kind stands for all."""
    ship_package(docs.sparkSession)
    own = own_names(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, (rules, more, _) in zip(batch.column("text").to_pylist(), _scan_texts(batch.column("text"), model)):
                at, parts = 0, []
                for s, k, e in sorted([(s, k, e) for k, s, e in rules] + [(s, 3, e) for s, e, _ in more]):
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k]}]"]
                    at = max(at, e)
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(run, f"doc_id {kind}, text string").toDF(id_col, text_col)
