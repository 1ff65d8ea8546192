"""Secret scans: fixed patterns, and a character convolutional network over every further candidate and its context.

Candidates are runs of 12 or more token characters, dots between them included, that aren't one plain word and that patterns
haven't found to the full. The network sees the candidate and the characters around it. It is trained on labelled findings: all
that the patterns find in the documents (1), all candidates there that the patterns don't touch (0), and findings made by rule
from a fixed seed, for what the documents have too few of. Tasks train on their shares of the documents' findings, and their weights
are averaged after each round. Scores are calibrated on one held-out part of all findings, and the threshold is the highest that
keeps the wanted recall on another, of the documents' findings and of the made ones each; documents, not findings, are held out.
What the patterns found is scored as well, and keeps its place whatever the score.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import LOWER, Stored, small_batches, text_slices, tidy, tidy_table

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_=.-]{12})[A-Za-z0-9+/_=-]+(?:\.+[A-Za-z0-9+/_=-]+)*")
_PLAIN = re.compile(r"[A-Z]?[a-z]+(?:[-.'][A-Z]?[a-z]+)*|[A-Z]+|[0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Characters before, of and after a window that the network sees; a longer candidate has several, STEP apart and the last at its
#: end, counts by the one of greatest score, and is found whole.
BEFORE, INSIDE, AFTER, STEP = 24, 40, 8, 8
#: Labelled findings made for training, the part of them that is held out, and the recall that the threshold keeps there.
FINDINGS, HELD_OUT, RECALL = 3000, 0.33, 0.98
#: Findings of documents in a task's share (about), rounds after which the tasks' weights are averaged, and turns over a share in each.
SHARE, ROUNDS, TURNS = 4096, 3, 2
#: Bins of a unit of a logit, and the units on either side of zero, in which held-out findings are counted.
BINS, REACH = 64, 40


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end in code points) of the patterns: whole matches, leftmost and non-overlapping in each kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters, not plain words or numbers, of which base spans leave something over."""
    out = []
    spans = sorted((a, b) for _, a, b in base)
    first = 0
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        if e - s < 12 or _PLAIN.fullmatch(m[0]):
            continue
        while first < len(spans) and spans[first][1] <= s:
            first += 1
        covered, k = s, first
        while k < len(spans) and spans[k][0] <= covered:
            covered, k = max(covered, spans[k][1]), k + 1
        if covered < e:
            out.append((s, e))
    return out


_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate(string.ascii_lowercase + string.digits + "+/_.=-:;,\"'`()[]{}<>@#%&*!?\\|~^$ \n\t"):
    _CODE[ord(_c)] = _i + 1
_UPPER = np.array([chr(i).isupper() for i in range(128)])
SYMBOLS = int(_CODE.max()) + 2


def _windows(items: list[tuple[str, int, int]]) -> np.ndarray:
    """The codes of the characters of each window: letters without case, and apart from them whether they are capitals."""
    width = BEFORE + INSIDE + AFTER
    out = np.zeros((len(items), width, 2), np.int64)
    for k, (text, s, e) in enumerate(items):
        before, inside, after = text[max(0, s - BEFORE) : s], text[s : min(e, s + INSIDE)], text[e : e + AFTER]
        for at, part in ((BEFORE - len(before), before), (BEFORE, inside), (BEFORE + INSIDE, after)):
            c = np.array([ord(x) for x in part], np.int64)
            low = np.minimum(c, 127)
            lower = np.where(_UPPER[low], low + 32, low)
            out[k, at : at + len(c), 0] = np.where(c < 128, _CODE[lower], SYMBOLS - 1)
            out[k, at : at + len(c), 1] = _UPPER[low] & (c < 128)
    return out


def _slices(s: int, e: int) -> list[tuple[int, int]]:
    """The windows of a candidate: every character of it is in one."""
    if e - s <= INSIDE:
        return [(s, e)]
    return [*((a, a + INSIDE) for a in range(s, e - INSIDE, STEP)), (e - INSIDE, e)]


_WEIGHTS = ("embed", "kernel", "bias", "dense")


@dataclass
class Network:
    """Embedding, one convolution of width 5, maximum and mean over places, one dense layer."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, w: np.ndarray) -> tuple[np.ndarray, ...]:
        x = np.concatenate([self.embed[w[:, :, 0]], w[:, :, 1:].astype(np.float64), np.broadcast_to(_PLACE, (len(w), *_PLACE.shape))], 2)
        cols = np.concatenate([x[:, i : x.shape[1] - 4 + i] for i in range(5)], 2)
        pre = cols @ self.kernel + self.bias
        h = np.maximum(pre, 0)
        pooled = np.concatenate([h.max(1), h.mean(1)], 1)
        return x, cols, h, pooled, pooled @ self.dense + self.out

    def probability(self, w: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of windows."""
        return self._calibrated(np.concatenate([self._forward(w[i : i + 512])[4] for i in range(0, len(w), 512)]) if len(w) else np.zeros(0))

    def _calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logits + self.shift)))

    def logits(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """Of whole candidates: the greatest of their windows."""
        out = np.full(len(items), -np.inf)
        windows = ((k, a, b) for k, (_, s, e) in enumerate(items) for a, b in _slices(s, e))
        while part := list(islice(windows, 512)):
            np.maximum.at(out, [k for k, _, _ in part], self._forward(_windows([(items[k][0], a, b) for k, a, b in part]))[4])
        return out

    def dumps(self) -> str:
        """The weights as JSON, to be stored and loaded."""
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else float(v) for k, v in self.__dict__.items()})

    @classmethod
    def loads(cls, text: str) -> Network:
        return cls(**{k: np.array(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def copied(self) -> Network:
        return replace(self, **{k: getattr(self, k).copy() for k in _WEIGHTS})

    def flat(self) -> np.ndarray:
        """All weights, one after another."""
        return np.concatenate([*(getattr(self, k).ravel() for k in _WEIGHTS), [self.out]])

    def unflat(self, flat: np.ndarray) -> Network:
        """The network with these weights."""
        ends = np.cumsum([getattr(self, k).size for k in _WEIGHTS])
        made = {k: x.reshape(getattr(self, k).shape) for k, x in zip(_WEIGHTS, np.split(flat[:-1], ends[:-1]), strict=True)}
        return replace(self, **made, out=float(flat[-1]))

    def scores(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities of whole candidates."""
        return self._calibrated(self.logits(items))


_PLACE = np.zeros((BEFORE + INSIDE + AFTER, 2))
_PLACE[:BEFORE, 0] = _PLACE[BEFORE : BEFORE + INSIDE, 1] = 1


def labelled_findings(n: int = FINDINGS, seed: int = 6) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Findings made by rule: random keys, tokens and digests in the places they stand (1); names, paths, versions, dates and numbers (0)."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), int(k)))
    vowels, consonants = "aeiou", "bcdfghlmnprst"
    word = lambda: "".join(pick(consonants, 1) + pick(vowels, 1) for _ in range(rng.integers(1, 5)))
    alnum = string.ascii_letters + string.digits
    items, labels = [], []
    for i in range(n):
        before = " ".join(word() for _ in range(rng.integers(1, 6))) + " "
        after = " " + " ".join(word() for _ in range(3))
        secret = i % 2
        if secret:
            kind = rng.integers(0, 6)
            size = rng.integers(20, 64)
            piece = [lambda: pick(alnum, size), lambda: pick(alnum + "+/", size) + "==", lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: pick(string.ascii_uppercase + string.digits, size), lambda: "xox" + pick("bp", 1) + "-" + pick(string.digits, 12) + "-" + pick(alnum, 24)][kind]()
            before += ["", "key ", "bearer ", "auth: ", "credential=", "private_key: ", "login ", "access key "][rng.integers(0, 8)]
            if rng.random() < 0.3:
                before, after = before + '"', '"' + after
        else:
            kind = rng.integers(0, 7)
            number = lambda k: pick(string.digits, k)
            piece = [
                lambda: "_".join(word() for _ in range(rng.integers(3, 6))) + "_" + number(rng.integers(1, 4)),
                lambda: "/".join(word() for _ in range(rng.integers(3, 7))) + "/" + number(rng.integers(1, 6)),
                lambda: "-".join(word() for _ in range(rng.integers(3, 7))) + "-" + number(4),
                lambda: "20" + number(2) + "-" + number(2) + "-" + number(2) + "T" + number(6) + "Z",
                lambda: "".join(word().title() for _ in range(rng.integers(3, 6))) + number(rng.integers(1, 4)),
                lambda: word() + "-" + number(1) + "_" + number(1) + "_" + number(1) + "-" + "_".join(word() for _ in range(2)),
                lambda: "".join(word() for _ in range(rng.integers(4, 8))) + number(rng.integers(1, 3)),
            ][kind]()
            before += ["", "see ", "file ", "the ", "version ", "page ", "id "][rng.integers(0, 7)]
        items.append((before + piece + after, len(before), len(before) + len(piece)))
        labels.append(secret)
    return items, np.array(labels, np.float64)


def drawn(df: DataFrame, text_col: str = "text") -> DataFrame:
    """label, held, context, start, stop: all that the patterns find in documents (1), and all candidates that they don't touch (0),
    each with the characters around it; held tells the documents that are held out. Equal contexts stand once."""
    from zlib import crc32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, _, data, offsets in text_slices(batch.column(0)):
                for d in sorted(_suspects(data, offsets)) if len(data) else []:
                    text = bytes(data[offsets[d] : offsets[d + 1]]).decode()
                    base, mark = base_spans(text), crc32(bytes(data[offsets[d] : offsets[d + 1]]))
                    for label, a, b in [*((1, a, b) for _, a, b in base), *((0, a, b) for a, b in untouched(text, base))]:
                        first, stop = max(0, a - BEFORE), min(b, a + INSIDE)
                        out.append((label, mark % 3 == 0, text[first:stop] + text[b : b + AFTER], a - first, stop - first))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "held", "context", "start", "stop"])

    rows = df.select(F.col(f"`{text_col}`")).mapInArrow(tidy(run), "label int, held boolean, context string, start int, stop int")
    return rows.groupBy("label", "context", "start", "stop").agg(F.max("held").alias("held"))


def untouched(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The candidates of a text that no base span meets."""
    out, spans, first, reach = [], sorted((a, b) for _, a, b in base), 0, 0
    for s, e in candidates(text, base):
        while first < len(spans) and spans[first][0] < e:
            reach, first = max(reach, spans[first][1]), first + 1
        if reach <= s:
            out.append((s, e))
    return out


def fit(df: DataFrame, text_col: str = "text") -> Network:
    """A network of all the documents' own findings, and of made ones.

    It begins as that of the made findings. In each round every share of the documents' findings, dealt by a hash, is trained on
    beside the made ones, and the weights are averaged by the shares' sizes. What comes to the driver is a row a weight, and then
    the counts of the held-out findings' scores in bins, whose number is fixed; calibration and threshold are of these counts."""
    found = Stored(drawn(df, text_col), "findings")
    rows, net = found.read(), trained()
    own = rows.where("not held")
    if n := own.count():
        items, y = labelled_findings()
        made = np.setdiff1d(np.arange(len(y)), np.concatenate(parts(len(y))))
        w = _windows([items[i] for i in made]).astype(np.uint8)
        for turn in range(ROUNDS):
            net = _averaged(own, -(-n // SHARE), net, w, y[made], turn)
    net = _set(net, _binned(rows.where("held"), net))
    found.drop()
    return net


def _averaged(rows: DataFrame, shares: int, net: Network, made: np.ndarray, labels: np.ndarray, turn: int) -> Network:
    """The mean of the networks that the shares of the rows give, each from this one on."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("context", "start", "stop", "label")])
        items = list(zip(table["context"].to_pylist(), table["start"].to_pylist(), table["stop"].to_pylist(), strict=True))
        w, y = np.concatenate([made, _windows(items)]), np.append(labels, table["label"].to_numpy())
        few = np.arange(len(made), len(w))  # a few findings of documents weigh as much as the made ones
        order = np.concatenate([np.arange(len(made)), np.tile(few, max(1, len(made) // (2 * len(few))))])
        mine = net.copied()
        _train(mine, w, y, order, TURNS, np.random.default_rng(turn))
        flat = mine.flat()
        return pa.table({"place": np.arange(len(flat), dtype=np.int32), "total": flat * len(few), "n": np.full(len(flat), float(len(few)))})

    part = F.pmod(F.xxhash64("context", "start", "stop"), F.lit(shares)).cast("int")
    dealt = rows.select("label", "context", "start", "stop", part.alias("part")).repartition(shares, "part")
    sums = dealt.groupBy("part").applyInArrow(tidy_table(run), "place int, total double, n double")
    mean = sums.groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("place").collect()
    return net.unflat(np.round([r["mean"] for r in mean], 9))  # the order of sums leaves no trace


def _binned(rows: DataFrame, net: Network) -> np.ndarray:
    """label, half, bin, count of findings by the bins of their logits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = net.logits(list(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)))
            bins = np.floor(np.clip(logits * BINS, -REACH * BINS, REACH * BINS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins)], ["label", "half", "bin"])

    half = F.pmod(F.xxhash64("context", "stop"), F.lit(2)).cast("int").alias("half")
    counts = rows.select("label", half, "context", "start", "stop").mapInArrow(tidy(run), "label int, half int, bin int").groupBy("label", "half", "bin").count()
    return np.array(sorted(tuple(r) for r in counts.collect()), np.int64).reshape(-1, 4)


def _set(net: Network, counts: np.ndarray) -> Network:
    """The network, calibrated on the made findings held out for that and on one half of the counts, with the threshold of the others."""
    items, y = labelled_findings()
    held, kept = parts(len(y))
    own, rest = (counts[counts[:, 1] == half] for half in (0, 1))
    logits = np.append(net.logits([items[i] for i in held]), (own[:, 2] + 0.5) / BINS)
    a, b = _platt(logits, np.append(y[held], own[:, 0]), np.append(np.ones(len(held)), own[:, 3]))
    net = replace(net, scale=a, shift=b)
    least = [np.quantile(net.scores([items[i] for i in kept if y[i]]), 1 - RECALL)]
    rest = rest[rest[:, 0] == 1]
    if len(rest):
        below = np.cumsum(rest[:, 3]) - rest[:, 3]
        edge = rest[below <= (1 - RECALL) * rest[:, 3].sum(), 2][-1]
        least.append(net._calibrated(edge / BINS) if edge > -REACH * BINS else 0.0)
    return replace(net, threshold=float(min(least)))


def parts(made: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of `made` findings are held out, in two parts: for calibration, and for the threshold."""
    order = np.random.default_rng(7).permutation(made)
    size = int(made * HELD_OUT) // 2
    return order[:size], order[size : 2 * size]


@lru_cache(maxsize=1)
def trained() -> Network:
    """The network of made findings alone, calibrated on a half of those held out, with the threshold of the other."""
    items, y = labelled_findings()
    rng = np.random.default_rng(7)
    own = rng.permutation(np.setdiff1d(np.arange(len(y)), np.concatenate(parts(len(y)))))
    size, filters = 12, 24
    net = Network(rng.normal(0, 0.3, (SYMBOLS, size)), rng.normal(0, 0.15, (5 * (size + 3), filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters), 0.0)
    _train(net, _windows(items), y, own, 6, rng)
    return _set(net, np.zeros((0, 4), np.int64))


def _train(net: Network, w: np.ndarray, y: np.ndarray, own: np.ndarray, turns: int, rng: np.random.Generator) -> None:
    """Trains on rows of windows, by stochastic gradients with momentum estimates."""
    size, filters = net.embed.shape[1], len(net.bias)
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in _WEIGHTS} for _ in range(2))
    step = 0
    for _ in range(turns):
        rng.shuffle(own)
        for at in range(0, len(own), 64):
            rows = own[at : at + 64]
            x, cols, h, pooled, logit = net._forward(w[rows])
            g = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            gp = g[:, None] * net.dense
            gh = np.repeat(gp[:, None, filters:] / h.shape[1], h.shape[1], 1)
            top = h.argmax(1)
            np.add.at(gh, (np.arange(len(rows))[:, None], top, np.arange(filters)[None, :]), gp[:, :filters])
            gh = gh * (h > 0)
            gc = gh @ net.kernel.T
            gx = np.zeros_like(x)
            for i in range(5):
                gx[:, i : x.shape[1] - 4 + i] += gc[:, :, i * x.shape[2] : (i + 1) * x.shape[2]]
            ge = np.zeros_like(net.embed)
            np.add.at(ge, w[rows][:, :, 0], gx[:, :, :size])
            grads = {"embed": ge, "kernel": np.einsum("npc,npf->cf", cols, gh), "bias": gh.sum((0, 1)), "dense": pooled.T @ g}
            step += 1
            net.out -= 0.05 * g.sum()
            for k in _WEIGHTS:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                getattr(net, k)[...] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def _platt(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt scaling: scale and shift."""
    a, b, weight = 1.0, 0.0, weight / weight.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * logits + b)))
        a, b = a - 0.05 * ((p - y) * logits) @ weight, b - 0.05 * (p - y) @ weight
    return float(a), float(b)


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[*(string.ascii_letters + string.digits + "+/_=.-").encode()]] = True
#: What a plain word hasn't, but for a capital in front and hyphens.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[*(string.ascii_uppercase + string.digits + "+/_=.").encode()]] = True


def _long_runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def _suspects(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts that can hold a span: found in the bytes of many texts at once. (A run may cross texts; then both are looked at.)"""
    docs: set[int] = set()
    at: list[int] = []
    low = LOWER[data].tobytes()
    for word in _WORDS:
        p = low.find(word)
        while p >= 0:
            at.append(p)
            p = low.find(word, p + 1)
    p = low.find(b"akia")
    while p >= 0:
        at.append(p)
        p = low.find(b"akia", p + 1)
    start, end = _long_runs(_HEX_BYTE[data], 16)
    s2, e2 = _long_runs(_TOKEN_BYTE[data], 12)
    odd = np.concatenate([[0], np.cumsum(_ODD_BYTE[data])])
    some = odd[np.maximum(e2 - 1, s2 + 1)] > odd[s2 + 1]  # the first may be a capital, the last a full stop
    for s, e in ((start, end), (s2[some], e2[some])):
        a, b = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, e - 1, "right") - 1
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            docs.update(range(x, y + 1))
    docs.update((np.searchsorted(offsets, np.array(at, np.int64), "right") - 1).tolist())
    return docs


def find(net: Network, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """All spans of each text with their probabilities, by start, then kind: those of the patterns, and candidates from the threshold on."""
    asked: list[tuple[int, str, int, int]] = []
    for k, text in enumerate(texts):
        base = base_spans(text)
        asked += [(k, *x) for x in base] + [(k, "learned", s, e) for s, e in candidates(text, base)]
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if asked:
        for (k, kind, s, e), p in zip(asked, net.scores([(texts[k], s, e) for k, _, s, e in asked]).tolist(), strict=True):
            if kind != "learned" or p >= net.threshold:
                found[k].append((kind, s, e, p))
    return [sorted(x, key=lambda y: (y[1], KINDS.index(y[0]))) for x in found]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "digest", network: Network | None = None) -> DataFrame:
    """Finds secrets in every whole text.

    out="digest": id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined by start, then kind),
    probabilities (of the spans, in their order, to four places). out="spans": id and spans array<struct<kind, start, end,
    probability>>. Starts and ends are code points of whole matches, ends exclusive. Spans of two kinds may overlap, and of
    equal starts the kinds' order counts. A null or empty text has none. A very long text is searched whole, and a long
    candidate in windows, 512 at a time. Without a network one is fitted on the table's own findings. Every row has a row, repeated ones too; an empty table gives none; other columns are
    left out.
    """
    small_batches(df.sparkSession)
    net = network or fit(df, text_col)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)
        for batch in batches:
            spans: list[list[tuple[str, int, int, float]]] = []
            for i, j, data, offsets in text_slices(batch.column(1)):
                at = sorted(_suspects(data, offsets)) if len(data) else []
                at = [d for d in at if offsets[d] < offsets[d + 1]]
                own = dict(zip(at, find(net, [bytes(data[offsets[d] : offsets[d + 1]]).decode() for d in at]), strict=True))
                spans += [own.get(d, []) for d in range(j - i)]
            if out == "spans":
                kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "probability"), x, strict=True)) for x in s] for s in spans], kinds)], [id_col, "spans"])
                continue
            counts = [pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in KINDS[:3]]
            digest = [hashlib.sha256(joined([x for x in s if x[0] != "learned"]).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([joined(s) for s in spans], pa.string()), pa.array([",".join(f"{x[3]:.4f}" for x in s) for s in spans], pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "probabilities"])

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, probabilities string" if out == "digest" else "spans array<struct<kind: string, start: long, end: long, probability: double>>"
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(tidy(run), f"`{id_col}` {kind}, {schema}")


def redact(text: str, spans: list[tuple[str, int, int, float]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    end = -1
    for _, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            end = max(end, e)
            at = max(at, end)
            continue
        out += [text[at:s], mark]
        at = end = e
    return "".join([*out, text[at:]])


def redact_column(df: DataFrame, text_col: str = "text", network: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the mark in the text for each stretch that spans cover; a null text stays null. Repeated rows have
    a row each, an empty table gives none. Without a network one is fitted on the table's own findings."""
    small_batches(df.sparkSession)
    net, place = network or fit(df, text_col), df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            changed: dict[int, str] = {}
            for i, _, data, offsets in text_slices(texts):
                at = [d for d in sorted(_suspects(data, offsets)) if offsets[d] < offsets[d + 1]] if len(data) else []
                own = [texts[i + d].as_py() for d in at]
                changed |= {i + d: redact(t, spans, mark) for d, t, spans in zip(at, own, find(net, own), strict=True) if spans}
            if changed:
                whole = texts.to_pylist()
                for d, t in changed.items():
                    whole[d] = t
                columns = list(batch.columns)
                columns[place] = pa.array(whole, texts.type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return df.mapInArrow(tidy(run), df.schema)
