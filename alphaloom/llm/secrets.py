"""Secret scan: rules, and a character convolutional network over every candidate in its context.

The rules give the base findings. A candidate is any run of eight or more characters that can be
a value: one with a digit, a sign or a change to upper case inside, or any that is assigned to a
name. The network, written in numpy, reads each of them with the characters before and after it;
of a long candidate it reads overlapping windows, from its first character to its last, and the highest
score counts. It is trained on labelled findings: all candidates of all documents,
labelled by the rules, and labelled findings made from fixed formats with a seed,
so that a table without secrets still has a network. A candidate that is assigned to a name of a
secret but meets no rule is no example of a clean one: such candidates are left out of training.
Three parts are held out of training, for the scaling of the scores, for the thresholds and for
the recall that the network states of itself. For each shape of candidate the threshold is the highest
that still finds the wished share of its part's secrets. Accepted candidates that no base finding
touches are added as spans of kind ``net``.

Fitting and scanning are one pass each over the documents, without a shuffle of them. Different windows, 72 bytes each, are
dealt to tasks; in an epoch every task trains a copy of the network on its own, and the mean of the copies goes on.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, sliced, written

# The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "net"]
HINTS = ("passw", "secret", "token", "api")

#: Fewest characters of a candidate.
LEAST = 8
#: Runs that can be values: token characters and those of passwords, then padding; a stop at the end is none of theirs.
RUN = re.compile(rf"[A-Za-z0-9+/_.\-@!#$%^&*~?]{{{LEAST},}}(?:={{1,2}}(?=[\s\"',;)&]|\Z))?")
VALUE = re.compile(r"[0-9]|[+/_@#$%^&*~=]|[a-z][A-Z]|[!?.][A-Za-z]")
ASSIGNED = re.compile(r"[A-Za-z0-9_][\"']?[ \t]{0,3}(?:[:=]|=>|:=)[ \t]{0,3}[\"']?\Z")
#: Names of secrets, before a candidate: what is assigned to one is not taken for clean.
NAMED = re.compile(r"(?i:pass|pwd|secret|token|key|auth|cred|bearer|private|pin\b|signature|session)")
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of findings, with repeats, that a task trains on.
DEAL = 32768
#: Characters from one window of a long candidate to the next.
STEP = INSIDE // 2
ALPHABET = string.ascii_letters + string.digits + "+/_.=-@:'\"(){}[]<>&?#%$*!,;| \n"
CODES = np.ones(128, np.int64)  # 0: nothing there, 1: any other character
CODES[[0, *map(ord, ALPHABET)]] = [0, *range(2, len(ALPHABET) + 2)]
SHAPES = ("digits", "hex", "letters", "mixed")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The rules' findings by start, then kind."""
    out: list[Span] = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans of all candidates: runs that look like values, and runs that are assigned to a name."""
    out = []
    for m in RUN.finditer(text):
        start, end = m.span()
        token = m[0].rstrip(".!?")
        if len(token) < LEAST:
            continue
        if VALUE.search(token) or ASSIGNED.search(text, max(0, start - 10), start):
            out.append((start, start + len(token)))
    return out


def shape(token: str) -> int:
    if token.isdigit():
        return 0
    if re.fullmatch("[0-9a-fA-F]+", token):
        return 1
    return 2 if token.isalpha() else 3


def windows(text: str, start: int, end: int) -> list[str]:
    """What the network reads of a candidate, each part padded with NUL: the text before it, INSIDE of its characters, the text
    after it; more than one window, overlapping, if it is longer."""
    before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
    starts = [start] if end - start <= INSIDE else [*range(start, end - INSIDE, STEP), end - INSIDE]
    return [before + text[at : min(end, at + INSIDE)].ljust(INSIDE, "\0") + after for at in starts]


def encode(seen: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(seen).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, CODES[np.minimum(points, 127)], 1).reshape(-1, WIDTH)


@dataclass
class CharNet:
    """Embedding, one convolution, ReLU, maximum over three parts of the window, and a logistic unit."""

    embed: np.ndarray  # codes x e
    conv: np.ndarray  # (k * e) x filters
    conv_bias: np.ndarray
    out: np.ndarray  # 3 * filters
    bias: np.ndarray
    k: int = 5
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5,) * len(SHAPES)
    #: The share of secrets, and of clean candidates, that the thresholds accept in the last part held out.
    recall: float = float("nan")
    false_alarms: float = float("nan")
    #: Different windows of the table's findings that it was trained on, scaled, constrained or measured by.
    fitted: int = 0

    PARTS = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH))

    @classmethod
    def new(cls, rng: np.random.Generator, e: int = 8, filters: int = 24, k: int = 5) -> CharNet:
        codes = len(ALPHABET) + 2
        return cls(rng.normal(0, 0.3, (codes, e)), rng.normal(0, (2 / (k * e)) ** 0.5, (k * e, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), np.zeros(1), k)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (self.k // 2, self.k // 2)))

    def _table(self) -> np.ndarray:
        """What each code adds to each filter at each place that the filter sees: k x codes x filters."""
        return np.matmul(self.embed, self.conv.reshape(self.k, self.embed.shape[1], -1)).astype(np.float32)

    def _maps(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The filters at each place of padded codes, without their bias: places x windows x filters."""
        maps = table[0].take(codes[:WIDTH], axis=0)
        for o in range(1, self.k):
            maps += table[o].take(codes[o : o + WIDTH], axis=0)
        return maps

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, padded, table = np.zeros(len(x), np.float32), self._padded(x), self._table()
        for i in range(0, len(x), 64):
            maps = self._maps(np.ascontiguousarray(padded[i : i + 64].T, np.intp), table)
            highest = np.concatenate([maps[a:b].max(axis=0) for a, b in self.PARTS], axis=1)
            out[i : i + 64] = np.maximum(highest + np.tile(self.conv_bias, 3), 0) @ self.out + self.bias[0]
        return out.astype(float)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(x))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.out, self.bias]

    def epoch(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 3e-3) -> None:
        """Adam on the logistic loss, over all rows. Both classes have the same weight; the rarer one comes round again, so that every batch has some of it."""
        classes = [c for c in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(c)]
        first = int(np.clip(round(batch * len(classes[0]) / len(x)), batch // 8, batch - batch // 8)) if len(classes) == 2 else batch
        shares = [first, batch - first][: len(classes)]
        steps = max(-(-len(c) // n) for c, n in zip(classes, shares, strict=True))
        order = np.concatenate([np.resize(rng.permutation(c), (steps, n)) for c, n in zip(classes, shares, strict=True)], axis=1)
        weight = np.concatenate([np.full(n, 1 / len(classes) / n) for n in shares])
        means, squares = [np.zeros_like(p) for p in self.weights()], [np.zeros_like(p) for p in self.weights()]
        padded, filters = self._padded(x), len(self.conv_bias)
        conv = self.conv.reshape(self.k, self.embed.shape[1], filters)
        place, offset = np.arange(WIDTH, dtype=np.uint8)[:, None, None], np.arange(self.k)[:, None, None]
        seen, own_cells = offset * batch + np.arange(batch)[:, None], offset * len(self.embed) * filters + np.tile(np.arange(filters), 3)
        for step, own in enumerate(order, 1):
            codes = np.ascontiguousarray(padded[own].T, np.intp)
            maps = self._maps(codes, self._table())
            highest = [maps[a:b].max(axis=0) for a, b in self.PARTS]
            # the last place of the highest, faster than argmax; equal ones see equal codes
            at = np.concatenate([((maps[a:b] == h) * place[a:b]).max(axis=0) for (a, b), h in zip(self.PARTS, highest, strict=True)], axis=1).astype(np.intp)
            pooled = np.maximum(np.concatenate(highest, axis=1) + np.tile(self.conv_bias, 3), 0)
            error = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias[0], -30, 30))) - y[own]) * weight
            back = error[:, None] * self.out * (pooled > 0)
            cells = codes.ravel().take(at * batch + seen) * filters + own_cells
            g_table = np.bincount(cells.ravel(), np.broadcast_to(back, cells.shape).ravel(), self.k * len(self.embed) * filters).reshape(self.k, -1, filters)
            grads = [
                np.matmul(g_table, conv.transpose(0, 2, 1)).sum(axis=0),
                np.matmul(self.embed.T, g_table).reshape(-1, filters),
                back.reshape(batch, 3, filters).sum(axis=(0, 1)),
                error @ pooled,
                np.array([error.sum()]),
            ]
            for q, g, m, v in zip(self.weights(), grads, means, squares, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def made_findings(n: int, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """n labelled findings (before, token, after, label) in fixed formats."""
    rng = random.Random(seed)
    pick = lambda chars, low, high: "".join(rng.choices(chars, k=rng.randint(low, high)))
    word = lambda: pick("aeioulnrstdhcm", 2, 9)
    prose = lambda: " ".join(word() for _ in range(4))
    mixed = string.ascii_letters + string.digits
    digits, hexes = string.digits, "0123456789abcdef"
    keys = ["pwd", "private_key", "client_secret", "access_token", "auth", "credential", "Authorization: Bearer", "apikey", "secret_key", "pass", "passphrase", "db_pass", "pin", "session"]
    names = ["see", "file", "name", "title", "date", "url", "page", "ref", "order", "user", "note", "path"]
    out = []
    for i in range(n):
        token, before, after, label = "", prose() + " ", " " + prose(), i % 2
        if label:
            kind = rng.randrange(9)
            token = (
                pick(mixed, 20, 44) if kind == 0
                else pick(hexes, 24, 64) if kind == 1
                else rng.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "rk_test_"]) + pick(mixed, 20, 36) if kind == 2
                else "eyJ" + pick(mixed, 20, 30) + "." + pick(mixed, 20, 40) + "." + pick(mixed + "-_", 20, 43) if kind == 3
                else pick(mixed + "+/", 40, 160) + "=" if kind == 4
                else pick(mixed + "!@#$%^&*~", 8, 15) if kind == 5
                else pick(string.ascii_letters, 8, 20) if kind == 6
                else pick(digits, 8, 12) if kind == 7
                else word().capitalize() + word() + rng.choice("!@#$%&*") + pick(digits, 2, 4)
            ).ljust(LEAST, "7").rstrip(".!?").ljust(LEAST, "7")
            before += rng.choice(keys) + rng.choice([" = ", "=", ": ", ' = "', '="', ":"])
            after = rng.choice(['"', "", " ", "\n"]) + after
        else:
            kind = rng.randrange(14)
            token = (
                pick(digits, 8, 19) if kind == 0
                else ".".join(word() for _ in range(2)) + "." + pick(digits, 2, 2) + "-" + pick(digits, 4, 8) if kind == 1
                else f"www.{word()}.example.com/{word()}/{pick(digits, 1, 5)}" if kind == 2
                else f"{word()}_{word()}_{word()}_{pick(digits, 1, 3)}.txt" if kind == 3
                else f"20{pick(digits, 2, 2)}-0{pick('123456789', 1, 1)}-1{pick(digits, 1, 1)}-{pick(digits, 6, 8)}" if kind == 4
                else "-".join(pick(digits, 3, 5) for _ in range(4)) if kind == 5
                else ".".join(pick(digits, 3, 3) for _ in range(4)) if kind == 6
                else word() + word() + word() + word() + pick(digits, 1, 2) if kind == 7
                else "/".join(word() for _ in range(rng.randint(3, 24))) + f"-{pick(digits, 1, 2)}.html" if kind == 8
                else word() + word().capitalize() + word() if kind == 9
                else word() + word() + word() if kind == 10
                else f"{word()}.{word()}@{word()}.example.org" if kind == 11
                else "-".join(word() for _ in range(3)) + "/" + word() if kind == 12
                else word().upper() + "_" + word().upper() + pick(digits, 0, 2)
            ).ljust(LEAST, "0").rstrip(".!?").ljust(LEAST, "0")
            before += rng.choice(["", "", "see ", "no. ", "(", "id: ", "mail ", f"{word()}: ", f"{rng.choice(names)}: ", f"{rng.choice(names)}=", f"{rng.choice(names)} = "])
            after = rng.choice(["", ".", ",", ")", "\n"]) + after
        out.append((before, token, after, label))
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Codes of windows as binary, a byte each."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * WIDTH, WIDTH, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.uint8))])


def table_findings(docs: DataFrame) -> DataFrame:
    """x (codes), shape and label of every window of every candidate of the documents; 1: a secret by the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen, shapes, labels = [], [], []
            for text in batch.column(0).to_pylist():
                spans = candidates(text) if text else []
                base = base_spans(text) if spans else []
                for a, b in spans:
                    label = int(any(a < e and s < b for s, e, _ in base))
                    if not label and ASSIGNED.search(text, max(0, a - 10), a) and NAMED.search(text, max(0, a - BEFORE), a):
                        continue
                    of = windows(text, a, b)
                    seen += of
                    shapes += [shape(text[a:b])] * len(of)
                    labels += [label] * len(of)
            yield pa.RecordBatch.from_arrays([packed(encode(seen)), pa.array(shapes, pa.int32()), pa.array(labels, pa.int32())], names=["x", "shape", "label"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "x binary, shape int, label int")


Findings = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _read(batches: Iterator[pa.RecordBatch]) -> Findings:
    """(codes, shape, label, part) of the batches' rows."""
    got = [(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH), *(b.column(i).to_numpy() for i in (1, 2, 3))) for b in batches]
    return tuple(map(np.concatenate, zip(*got, strict=True))) if got else (np.zeros((0, WIDTH), np.uint8), *np.zeros((3, 0), int))


def _trained(dealt: DataFrame, made: Findings, net: CharNet, seed: int) -> CharNet:
    """The network after an epoch over all rows: each task trains its own one on its rows and the made ones; their mean counts."""
    x, _, y, part = made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_x, _, own_y, own_part = _read(batches)
        n, place = int((own_part > 2).sum()), TaskContext.get().partitionId()
        if n:
            own = deepcopy(net)
            own.epoch(np.concatenate([own_x[own_part > 2], x[part > 2]]), np.concatenate([own_y[own_part > 2], y[part > 2]]), np.random.default_rng((seed, place)))
            flat = np.concatenate([w.ravel() for w in own.weights()]).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([n]), pa.array([flat], pa.binary())], names=["place", "n", "weights"])

    out = deepcopy(net)
    out.fitted = 0
    # the order of places, so that the mean is the same each time
    rows = sorted(map(tuple, dealt.mapInArrow(run, "place long, n long, weights binary").collect()))
    if not rows:
        out.epoch(x[part > 2], y[part > 2], np.random.default_rng((seed, 0)))
        return out
    out.fitted = sum(n for _, n, _ in rows)
    mean = sum(n * np.frombuffer(w, "<f4").astype(float) for _, n, w in rows) / out.fitted
    for w, own in zip(out.weights(), np.split(mean, np.cumsum([w.size for w in out.weights()])[:-1]), strict=True):
        w[...] = own.reshape(w.shape)
    return out


def _ordered(bits: np.ndarray) -> np.ndarray:
    """The bits of single-precision numbers as integers of the same order, and back."""
    return bits ^ ((bits >> 31) & 0x7FFFFFFF)


def _held(dealt: DataFrame, made: Findings, net: CharNet) -> DataFrame:
    """place, part, shape, label, logit and key (its order) of the parts that are held out of training."""
    names, kinds = ["place", "part", "shape", "label", "logit", "key"], (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())

    def scored(found: Findings, place: int) -> pa.RecordBatch:
        x, shapes, y, part = (c[found[3] <= 2] for c in found)
        logits = net.logits(x)
        columns = [np.full(len(x), place), part, shapes, y, logits, _ordered(logits.astype(np.float32).view(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield scored(_read([batch]), TaskContext.get().partitionId())

    own = dealt.sparkSession.createDataFrame(scored(made, -1).to_pylist(), "place int, part int, shape int, label int, logit double, key int")
    return dealt.mapInArrow(run, own.schema).unionByName(own)


def _calibrate(held: DataFrame, net: CharNet, l2: float = 0.01) -> None:
    """Platt scaling of the scores: ridge logistic regression by Newton's method, both classes of the same weight."""
    rows = held.where("part = 0")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(count) < 2:
        return
    weight = F.when(F.col("label") == 1, sum(count.values()) / 2 / count[1]).otherwise(sum(count.values()) / 2 / count[0])
    w, ridge = np.zeros(2), np.array([1e-3, l2])
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") * float(w[1]) + float(w[0])))))
        of = rows.select("place", "logit", (weight * F.greatest(p * (1 - p), F.lit(1e-6))).alias("q"), (weight * (F.col("label") - p)).alias("g"))
        sums = of.groupBy("place").agg(F.sum("q"), F.sum(F.col("q") * F.col("logit")), F.sum(F.col("q") * F.col("logit") ** 2), F.sum("g"), F.sum(F.col("g") * F.col("logit"))).collect()
        q, ql, qll, g, gl = (math.fsum(r[i] for r in sums) for i in range(1, 6))
        step = np.linalg.solve(np.array([[q, ql], [ql, qll]]) + np.diag(ridge), np.array([g, gl]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    net.scale = (float(w[1]), float(w[0]))


def _constrain(held: DataFrame, net: CharNet, recall: float) -> None:
    """For each shape the highest threshold, of 0.5 at most, that finds the wished share of its secrets: a rank among all of them, found by counts."""
    rows = held.where("part = 1 AND label = 1").select("shape", "key", F.shiftright("key", 16).alias("high"))

    def reached(counts: list, place: int) -> tuple[int, int]:
        """(the value that holds a place, the place within it)"""
        for value, n in sorted(counts):
            if place < n:
                return value, place
            place -= n
        raise AssertionError

    counts = rows.groupBy("shape", "high").count().collect()
    found = {}
    for s in {r["shape"] for r in counts}:
        own = [(r["high"], r["count"]) for r in counts if r["shape"] == s]
        n = sum(k for _, k in own)
        place = int((1 - recall) * n)
        found[s] = reached(own, place if net.scale[0] > 0 else n - 1 - place)
    out = [0.5] * len(SHAPES)
    if found:
        here = F.array(*(F.struct(F.lit(s).alias("shape"), F.lit(high).alias("high")) for s, (high, _) in found.items()))
        counts = rows.where(F.array_contains(here, F.struct("shape", "high"))).groupBy("shape", "key").count().collect()
        for s, (_, place) in found.items():
            key = reached([(r["key"], r["count"]) for r in counts if r["shape"] == s], place)[0]
            out[s] = min(0.5, float(net.scaled(_ordered(np.array([key], np.int32)).view(np.float32).astype(float))[0]))
    net.thresholds = tuple(out)


def _state(held: DataFrame, net: CharNet) -> None:
    """Keeps the shares of secrets and of clean candidates that are accepted."""
    a, b = net.scale
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") * a + b))))
    said = (p >= F.array(*map(F.lit, net.thresholds))[F.col("shape")]).cast("double")
    shares = {r["label"]: r["share"] for r in held.where("part = 2").groupBy("label").agg(F.avg(said).alias("share")).collect()}
    net.recall, net.false_alarms = shares.get(1, float("nan")), shares.get(0, float("nan"))


def fit_net(docs: DataFrame, *, made: int = 4000, recall: float = 0.98, epochs: int = 6, seed: int = 7) -> CharNet:
    """Trains the network on all different windows of the table's findings and on ``made`` made ones. Of ten, seven train it; one
    each scales its scores, sets its thresholds and measures what they find."""
    rng = np.random.default_rng(seed)
    own = [(seen, shape(t), y) for b, t, a, y in made_findings(made, seed) for seen in windows(b + t + a, len(b), len(b) + len(t))]
    made_ones = encode([w for w, _, _ in own]).astype(np.uint8), np.array([s for _, s, _ in own]), np.array([y for *_, y in own]), rng.integers(0, 10, len(own))
    net = CharNet.new(rng)
    found = written(table_findings(docs), "findings")
    dealt = found.repartition(max(1, -(-found.count() // DEAL)), "x", "shape", "label").distinct().sortWithinPartitions("x", "shape", "label")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(10)).cast("int")).persist(StorageLevel.DISK_ONLY)
    held = None
    try:
        for n in range(epochs):
            net = _trained(dealt, made_ones, net, seed + n)
        held = _held(dealt, made_ones, net).persist(StorageLevel.DISK_ONLY)
        net.fitted += held.where("place >= 0").count()
        _calibrate(held, net)
        _constrain(held, net, recall)
        _state(held, net)
    finally:
        for kept in (dealt, held):
            if kept is not None:
                kept.unpersist()
        discard(found)
    return net


def text_spans(texts: list[str | None], net: CharNet) -> list[list[Span]]:
    """All findings of each text, by start, then kind: the rules' and what the network adds."""
    out, asked, seen = [], [], []
    for n, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        out.append(base)
        ends = sorted((s, e) for s, e, _ in base)
        for a, b in candidates(text):
            of = windows(text, a, b)
            asked.append((n, a, b, len(of), any(a < e and s < b for s, e in ends)))
            seen += of
    if asked:
        # every candidate is scored; those that a rule has found are findings already
        p = net.probability(encode(seen))
        highest = np.maximum.reduceat(p, np.cumsum([0] + [k for _, _, _, k, _ in asked[:-1]]))
        for (n, a, b, _, known), q in zip(asked, highest, strict=True):
            if not known and q >= net.thresholds[shape(texts[n][a:b])]:
                out[n].append((a, b, "net"))
        for spans in out:
            spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, net: CharNet) -> DataFrame:
    """One row a document: doc_id, the counts n_assign, n_access, n_hex and n_net, base (the rules' spans as text) and spans (all).

    A null or empty text has no spans; a text of any length is read whole; a null doc_id stays null; repeated rows give repeated rows;
    other columns are ignored; an empty table gives no rows. Offsets are code points, end exclusive.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_spans(batch.column(1).to_pylist(), net)
        counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
        base = pa.array([listed([s for s in spans if s[2] != "net"]) for spans in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array(map(listed, found), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """text with each run of touching spans replaced by mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, net: CharNet) -> DataFrame:
    """docs with every secret replaced by [SECRET] and n_chars counted anew; no row goes."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(names.index("text")).to_pylist()
        new = [t if not s else redact(t, s) for t, s in zip(texts, text_spans(texts, net), strict=True)]
        columns = list(batch.columns)
        columns[names.index("text")] = pa.array(new, pa.string())
        if "n_chars" in names:
            old = batch.column(names.index("n_chars"))
            columns[names.index("n_chars")] = pa.array([n if t is s else len(t) for n, t, s in zip(old.to_pylist(), new, texts, strict=True)], old.type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, docs.schema)

