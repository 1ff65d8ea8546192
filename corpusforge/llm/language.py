"""Language identification of mixed-language text.

A word's script (by the range of its first letter's code point) narrows the languages it can be in; its score in each of them is the
sum of the log-probabilities of its byte trigrams, white space included; Viterbi with a penalty for switching labels spans of
words. The document's language is the one that labels the most bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import ASCII_SPACE, LOWER, small_batches, text_slices, tidy

#: Rows of each language that the model is fitted on, drawn by a hash of the id: documented bound of the sample, met on average.
SAMPLE_PER_LANGUAGE = 1500
#: Tasks that count the sample; each sends one table a language to the driver.
TASKS = 8
#: Log-odds that a switch of language costs.
SWITCH = 12.0
#: Places of the trigram table.
PLACES = 1 << 16
#: Bytes of text that are labelled at once; of a longer text, the bytes of a stretch.
SLICE, STRETCH = 1 << 20, 1 << 20
#: Scripts and the code points of their letters, from the Unicode blocks. 0: no letter of a known script.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian", "ethiopic", "kana", "han", "hangul")
RANGES = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0xAA), ("latin", 0xB5, 0xB5), ("latin", 0xBA, 0xBA), ("latin", 0xC0, 0xD6), ("latin", 0xD8, 0xF6), ("latin", 0xF8, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F),
    ("hebrew", 0x5D0, 0x5EA), ("arabic", 0x620, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("han", 0xF900, 0xFAFF), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F), ("han", 0x20000, 0x323AF),
]
_FIRST, _LAST = np.array([a for _, a, _ in RANGES]), np.array([b for _, _, b in RANGES])
_SCRIPT = np.array([SCRIPTS.index(x) for x, _, _ in RANGES], np.int8)
LETTER = regex.compile(r"\p{L}")


def script_of(code: np.ndarray) -> np.ndarray:
    """The script of each code point."""
    at = np.searchsorted(_FIRST, code, "right") - 1
    return np.where((at >= 0) & (code <= _LAST[at]), _SCRIPT[at], 0).astype(np.int8)


_ASCII_SCRIPT = script_of(np.arange(256) * (np.arange(256) < 128))


def _letters(data: np.ndarray) -> np.ndarray:
    """The script of the letter that begins at each byte of UTF-8; 0 elsewhere."""
    out = _ASCII_SCRIPT[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b, c, d, e = wide[lead], wide[lead + 1] & 63, wide[lead + 2] & 63, wide[lead + 3] & 63
        two, three = ((b & 31) << 6) | c, ((b & 15) << 12) | (c << 6) | d
        out[lead] = script_of(np.where(b < 0xE0, two, np.where(b < 0xF0, three, ((b & 7) << 18) | (c << 12) | (d << 6) | e)))
    return out


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The place of the byte trigram that ends at each byte; letters A-Z are lower, ASCII white space is one symbol."""
    low = np.where(ASCII_SPACE[data], 32, LOWER[data]).astype(np.uint32)
    padded = np.concatenate([np.full(2, 32, np.uint32), low])
    h = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(16)).astype(np.int64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (with the one white space after), and the text of each."""
    space = ASCII_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | fresh[1:-1]
    at = np.flatnonzero(begin)
    stop = space.copy()
    stop = np.flatnonzero(stop | fresh[:-1])
    end = np.append(stop, len(data))[np.searchsorted(stop, at, "right")]
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = np.minimum(end + 1, offsets[doc + 1])
    return at, inside, doc


@dataclass
class Model:
    languages: list[str]
    #: Log-probability of each trigram place in each language: PLACES x languages.
    table: np.ndarray
    #: Scripts x languages: whether the language was seen in the script.
    may: np.ndarray
    switch: float = SWITCH

    def label(self, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """For slices of the column: texts' offsets, words' starts, ends, texts, labels (numbers of languages), and each text's bytes by label."""
        k = len(self.languages)
        for i, j, data, offsets in text_slices(column, SLICE):
            if j - i == 1 and len(data) > SLICE:
                at, end, label = self._long(data)
                doc = np.zeros(len(at), np.int64)
            else:
                at, end, doc = _words(data, offsets)
                label = _viterbi(self._scores(data, at, end), doc, j - i, self.switch) if len(at) else at
            size = np.bincount(doc * k + label, end - at, (j - i) * k).reshape(j - i, k) if len(at) else np.zeros((j - i, k))
            yield offsets, at, end, doc, label, size

    def _scores(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's score in each language; languages not seen in the script of its first letter pay."""
        sums = np.zeros((len(data) + 1, len(self.languages)), np.float64)
        np.cumsum(self.table[_trigrams(data)], axis=0, out=sums[1:])
        script = _letters(data)
        letters = np.append(np.flatnonzero(script), len(data))
        first = letters[np.searchsorted(letters, at)]
        own = np.where(first < end, np.append(script, 0)[first], 0)
        return sums[end] - sums[at] + np.where(self.may[own], 0.0, -50.0)

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and labels of the words of one long text, a stretch at a time; what goes from one stretch to the next is the best
        score of each language, and of each word only where its labels came from is kept."""
        found, best, a = [], None, 0
        space = np.flatnonzero(ASCII_SPACE[data])
        while a < len(data):
            cut = np.searchsorted(space, a + STRETCH)
            b = int(space[cut]) + 1 if cut < len(space) else len(data)
            lead = min(2, a)  # the trigrams of the first bytes reach back
            part = data[a - lead : b]
            at, end, _ = _words(data[a:b], np.array([0, b - a]))
            if len(at):
                best, came = _forward(self._scores(part, at + lead, end + lead), best, self.switch)
                found.append((at + a, end + a, came))
            a = b
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        state, labels = int(best.argmax()), []
        for _, _, came in reversed(found):
            own = np.empty(len(came), np.int64)
            for t in range(len(came) - 1, -1, -1):
                own[t] = state
                state = came[t, state]
            labels.append(own)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.concatenate(labels[::-1])


def _forward(score: np.ndarray, best: np.ndarray | None, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The best score that ends in each label, and for each word and label the label before; ties as in _viterbi."""
    n, k = score.shape
    came, stay = np.empty((n, k), np.int16), np.arange(k)
    for t in range(n):
        if best is None:
            best, came[t] = score[t], stay
            continue
        top = int(best.argmax())
        moved = best[top] - switch > best
        came[t] = np.where(moved, top, stay)
        best = np.where(moved, best[top] - switch, best) + score[t]
    return best, came


def _viterbi(score: np.ndarray, doc: np.ndarray, docs: int, switch: float) -> np.ndarray:
    """The best label of each word, all texts a step at a time; ties go to staying, then to the first language."""
    n, k = score.shape
    length = np.bincount(doc, minlength=docs)
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    longest = length[order]
    came = np.empty((n, k), np.int16)
    best = score[first[longest > 0]]
    live = len(best)
    came[first[:live]] = np.arange(k)
    final = np.empty((live, k))
    for t in range(1, int(longest[0])):
        still = int(np.searchsorted(-longest, -t, "left"))  # texts with more than t words
        final[still:live], live = best[still:live], still
        now = first[:live] + t
        best = best[:live]
        top = best.argmax(1)
        jump = best[np.arange(live), top] - switch
        moved = jump[:, None] > best
        came[now] = np.where(moved, top[:, None], np.arange(k))
        best = np.where(moved, jump[:, None], best) + score[now]
    final[:live] = best
    label = np.empty(n, np.int64)
    count = int((longest > 0).sum())
    state = final[:count].argmax(1)
    for t in range(int(longest[0]) - 1, -1, -1):
        live = int(np.searchsorted(-longest, -t, "left"))
        now = first[:live] + t
        label[now] = state[:live]
        state[:live] = came[now, state[:live]]
    return label


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits trigram tables on about per_language rows of each language, drawn by a hash of the id (all, if there are fewer); whole texts.

    Rows of null language or text aren't used. The sample is counted by TASKS tasks, so that a fixed number of tables comes to
    the driver.
    """
    small_batches(df.sparkSession)
    place = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 30))
    rows = df.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), place.alias("h")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], np.zeros((PLACES, 0)), np.zeros((len(SCRIPTS), 0), bool))
    keep: Column = F.lit(False)
    for lang, n in totals.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("h") < int((1 << 30) * min(1.0, per_language / n))))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist())
            for i, j, data, offsets in text_slices(batch.column(1), SLICE):
                place, lead = _trigrams(data), _letters(data)
                for row in range(i, j):
                    t = tables.setdefault(lang[row], np.zeros(PLACES + len(SCRIPTS), np.int64))
                    a, b = offsets[row - i], offsets[row - i + 1]
                    t[:PLACES] += np.bincount(place[a:b], minlength=PLACES)
                    t[PLACES:] += np.bincount(lead[a:b], minlength=len(SCRIPTS))
        yield pa.RecordBatch.from_arrays([pa.array(list(tables)), pa.array([t.tobytes() for t in tables.values()], pa.binary())], ["lang", "counts"])

    languages = sorted(totals)
    tables = {x: np.zeros(PLACES + len(SCRIPTS), np.int64) for x in languages}
    for r in rows.where(keep).select("lang", "text").repartition(TASKS).mapInArrow(tidy(count), "lang string, counts binary").collect():
        tables[r["lang"]] += np.frombuffer(r["counts"], np.int64)
    counts = np.stack([tables[x][:PLACES] for x in languages], 1) + 0.1
    scripts = np.stack([tables[x][PLACES:] for x in languages], 1).astype(np.float64)
    may = scripts / np.maximum(scripts.sum(0), 1) > 0.01
    may[0] = True
    may[~may.any(1)] = True
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32), may)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "documents") -> DataFrame:
    """Labels every whole text.

    out="documents": id, lang_pred, score (the share of the words' bytes that carry the label). out="spans": id and spans
    array<struct<lang, start, end>>, in bytes of UTF-8. A null text, one without a letter, and any text for a model without
    languages is "und" with score 0 and no spans. Of labels with equally many bytes the first by name counts. A very long text
    is labelled in stretches that hand on the state, so its memory is some bytes for each word and language. Each row has a row,
    repeated ones too; an empty table gives none; other columns are left out.
    """
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    spans = out == "spans"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            text = batch.column(1)
            if not spans:
                pred, score = _predict(model, text)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])
                continue
            runs: list[list[dict]] = [[] for _ in range(len(text))]
            letter = [bool(LETTER.search(x.as_py() or "")) for x in text]
            done = 0
            for base, at, end, doc, label, size in model.label(text) if model.languages else ():
                start = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(label) != 0))) if len(at) else at
                last = np.append(start[1:], len(at))[: len(start)] - 1
                for s, e in zip(start.tolist(), last.tolist(), strict=True):
                    if letter[done + int(doc[s])]:
                        runs[done + int(doc[s])].append({"lang": names[label[s]], "start": int(at[s] - base[doc[s]]), "end": int(end[e] - base[doc[s]])})
                done += len(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [id_col, "spans"])

    schema = "spans array<struct<lang: string, start: long, end: long>>" if spans else "lang_pred string, score double"
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(tidy(run), f"`{id_col}` {kind}, {schema}")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language (is not "und")."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, _ = _predict(model, batch.column(at))
            yield batch.filter(pa.array(pred < len(model.languages), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def _predict(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language (that after the last for none), and the share of the bytes that carry it."""
    none = len(model.languages)
    letter = np.array([bool(LETTER.search(x.as_py() or "")) for x in text], bool)
    pred, score, done = np.full(len(text), none), np.zeros(len(text)), 0
    for _, _, _, _, _, size in model.label(text) if none else ():
        own = slice(done, done + len(size))
        top = size.argmax(1)
        pred[own] = np.where(letter[own], top, none)
        score[own] = np.where(letter[own], size[np.arange(len(size)), top] / np.maximum(size.sum(1), 1), 0)
        done += len(size)
    return pred, score
