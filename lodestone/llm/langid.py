"""Language identification of mixed texts: script ranges, per-word scores, and a Viterbi path.

Words are runs of letters, lower-cased. A word's score for a language is the sum of log probabilities of its character
3-grams and 4-grams, word edges included, hashed into a table that is counted from labelled documents. The script of a
word's first letter leaves only the languages that use that script. A Viterbi path over the words, with a penalty for
each switch, labels spans; the language that holds most letters of a document is its language, and its share of the
letters is the score.

The path is exact for documents of any length and runs in numpy: words are cut into blocks, each block's best scores
from every state to every state are found for all blocks at once, then blocks are chained, then opened again. Very long
texts go through it in segments that end between words, forwards with the states' values, then backwards.

Fitting reads at most PER_LANGUAGE labelled documents of each language, chosen by a hash of the id.

Results for odd input: null texts and texts without a letter are und with score 0; letters of scripts that no learned
language uses count for none, and a text with only such letters gets the commonest learned language with score 0;
equal shares go to the language that sorts first; with no labelled document at all every result is und; an id that
labelled rows repeat counts once for each language; columns of any name are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_batches, pieces_of, slices

PER_LANGUAGE = 400
BUCKETS = 1 << 16
PENALTY = 12.0
BLOCK = 32
#: Characters scored at once.
BUDGET = 1_000_000

# First and last code point of the scripts told apart; all other letters count as script 0.
SCRIPTS = (
    (0x41, 0x24F),  # Latin
    (0x370, 0x3FF),  # Greek
    (0x400, 0x52F),  # Cyrillic
    (0x530, 0x58F),  # Armenian
    (0x590, 0x5FF),  # Hebrew
    (0x600, 0x77F),  # Arabic
    (0x900, 0x97F),  # Devanagari
    (0x980, 0x9FF),  # Bengali
    (0xB80, 0xBFF),  # Tamil
    (0xC00, 0xC7F),  # Telugu
    (0xE00, 0xE7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x3040, 0x30FF),  # Kana
    (0x4E00, 0x9FFF),  # Han
    (0xAC00, 0xD7AF),  # Hangul
)
NEVER = np.float32(-60.0)
_NO_LETTER = re.compile(r"\W|\d|_")


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: itself if a letter, else 0; and its script."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for k, (a, b) in enumerate(SCRIPTS, 1):
        script[a : b + 1] = k
    return np.where(letter, points, 0).astype(np.uint32), script


@dataclass
class Words:
    """The words of some texts: their text, letters, scripts; and the n-gram buckets of all letters in order."""

    text: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    start: np.ndarray
    grams: tuple[np.ndarray, np.ndarray]


def words_of(texts: list[str]) -> Words:
    letter, script = _letters()
    parts = [t.lower() for t in texts]
    flat = "\n\n" + "\n\n".join(parts) + "\n\n"
    c = letter[np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)]
    at = np.flatnonzero(c)
    first = at[c[at - 1] == 0]
    start = np.searchsorted(at, first)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 2)
    mixed = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[at + 1] * np.uint32(0xC2B2AE3D)
    longer = (mixed ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) ^ c[at - 2] * np.uint32(0xD3A2646C | 1)
    grams = tuple(((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32) for h in (mixed, longer))
    return Words(
        np.searchsorted(ends, first, "right") if len(parts) else np.zeros(0, np.int64),
        np.diff(np.r_[start, len(at)]),
        script[c[first]],
        start,
        grams,
    )


@dataclass
class Model:
    languages: list[str]
    commonest: int
    tables: tuple[np.ndarray, np.ndarray]
    allowed: np.ndarray  # script, language

    def scores(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.start), len(self.languages)), np.float32)
        if len(w.start):
            for table, gram in zip(self.tables, w.grams, strict=True):
                out += np.add.reduceat(table[gram], w.start, axis=0)
            some = self.allowed.any(axis=1)[w.script]
            out[some[:, None] & ~self.allowed[w.script]] = NEVER * 100
            out[~some] = 0
        return out


def viterbi(
    scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY, value: np.ndarray | None = None, end: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best state of every word; each sequence's values at its end; and the state before its first word.

    scores: words by states; sizes: words of each sequence, none of them 0. Ties stay in the state they are in, else go
    to the first state. For a sequence that goes on, value holds its states' values so far, and end its last state.
    """
    states = scores.shape[1]
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    offset = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(first * BLOCK, sizes) + offset
    s = np.zeros((int(blocks.sum()) * BLOCK, states), np.float32)  # the words added at the end score alike in all states
    s[place] = scores
    s = s.reshape(-1, BLOCK, states)
    penalty = np.float32(penalty)
    switch = (1 - np.eye(states, dtype=np.float32)) * penalty
    through = s[:, 0, None, :] - switch  # block, state before it, state at its end
    for t in range(1, BLOCK):
        best = through.max(axis=2, keepdims=True) - penalty
        np.maximum(through, best, out=through)
        through += s[:, t, None, :]
    value = np.zeros((len(sizes), states), np.float32) if value is None else value.astype(np.float32)
    came = np.zeros((len(s), states), np.int32)
    order = np.argsort(-blocks, kind="stable")
    counts = blocks[order]
    for k in range(int(counts[0]) if len(counts) else 0):
        who = order[: np.searchsorted(-counts, -k, "left")]
        total = value[who][:, :, None] + through[first[who] + k]
        came[first[who] + k] = total.argmax(axis=1)
        value[who] = total.max(axis=1)
        value[who] -= value[who].max(axis=1, keepdims=True)  # differences decide; keeps float32 exact enough
    last = np.zeros(len(s), np.int32)
    before = np.zeros(len(s), np.int32)
    state = (value.argmax(axis=1) if end is None else end).astype(np.int32)
    for k in range(int(counts[0]) - 1 if len(counts) else -1, -1, -1):
        who = order[: np.searchsorted(-counts, -k, "left")]
        b = first[who] + k
        last[b] = state[who]
        before[b] = state[who] = came[b, state[who]]
    rows = np.arange(len(s))
    through = s[:, 0] - switch[before]
    back = np.zeros((BLOCK, len(s), states), np.int8 if states < 128 else np.int32)
    own = np.arange(states)
    for t in range(1, BLOCK):
        best = through.argmax(axis=1)
        top = through[rows, best][:, None] - penalty
        stay = through >= top
        back[t] = np.where(stay, own, best[:, None])
        through = np.maximum(through, top) + s[:, t]
    path = np.zeros((len(s), BLOCK), np.int32)
    path[:, -1] = last
    for t in range(BLOCK - 1, 0, -1):
        path[:, t - 1] = back[t][rows, path[:, t]]
    return path.reshape(-1)[place], value, state


def _segments(text: str, budget: int) -> list[str]:
    """A long text in stretches of about budget characters that end where a character is no letter, so between words."""
    out = []
    while len(text) > 2 * budget:
        cut = _NO_LETTER.search(text, budget)
        if not cut:
            break
        out.append(text[: cut.start()])
        text = text[cut.start() :]
    return [*out, text]


@dataclass
class Labels:
    """Language states of the words of one text, its letters by state, and all its letters."""

    path: np.ndarray
    share: np.ndarray
    letters: int


def _together(model: Model, texts: list[str]) -> list[Labels]:
    """Labels of texts that are held at once."""
    w = words_of(texts)
    counts = np.bincount(w.text, minlength=len(texts))
    path = viterbi(model.scores(w), counts[counts > 0])[0] if len(w.start) else np.zeros(0, np.int32)
    return _shares(model, w, path, len(texts))


def _shares(model: Model, w: Words, path: np.ndarray, n_texts: int) -> list[Labels]:
    n = len(model.languages)
    counted = w.letters * model.allowed.any(axis=1)[w.script]
    share = np.bincount(w.text * n + path, counted, n_texts * n).reshape(-1, n)
    letters = np.bincount(w.text, w.letters, n_texts)
    paths = np.split(path, np.cumsum(np.bincount(w.text, minlength=n_texts))[:-1])
    return [Labels(p, s, int(k)) for p, s, k in zip(paths, share, letters, strict=True)]


def _in_turn(model: Model, segments: list[str]) -> Labels:
    """Labels of a text too long to be held: values are carried forwards through its segments, then states backwards."""
    values, value = [], None
    for segment in segments:
        values.append(value)
        w = words_of([segment])
        if len(w.start):
            value = viterbi(model.scores(w), np.array([len(w.start)]), value=value)[1]
    end, found = None, []
    for segment, value in zip(reversed(segments), reversed(values), strict=True):
        w = words_of([segment])
        if len(w.start):
            path, _, end = viterbi(model.scores(w), np.array([len(w.start)]), value=value, end=end)
            found.append(_shares(model, w, path, 1)[0])
    if not found:
        return Labels(np.zeros(0, np.int32), np.zeros(len(model.languages)), 0)
    return Labels(np.concatenate([f.path.astype(np.int16) for f in reversed(found)]), sum(f.share for f in found), sum(f.letters for f in found))


def budget(model: Model) -> int:
    """Characters scored at once; fewer with many languages, as a path's tables grow with their square."""
    return max(20_000, BUDGET * 64 // max(64, len(model.languages) ** 2))


def label(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """For each text its language, score and spans: (language, first word, words) of each run in one language."""
    if not model.languages:
        return [("und", 0.0, [])] * len(texts)
    most, found = budget(model), []
    for a, b in pieces_of(texts, most):
        if b == a + 1 and len(segments := _segments(texts[a] or "", most)) > 1:
            found.append(_in_turn(model, segments))
        else:
            found += _together(model, [t or "" for t in texts[a:b]])
    out = []
    for x in found:
        if not x.letters:
            out.append(("und", 0.0, []))
            continue
        best = int(x.share.argmax()) if x.share.any() else model.commonest
        turn = np.flatnonzero(np.r_[True, np.diff(x.path) != 0])
        spans = [(model.languages[x.path[i]], int(i), int(n)) for i, n in zip(turn, np.diff(np.r_[turn, len(x.path)]), strict=True)]
        out.append((model.languages[best], float(x.share[best] / x.letters), spans))
    return out


def fit(docs: DataFrame, training, per_language: int = PER_LANGUAGE) -> Model:
    """Counts n-grams of labelled documents: those where training, a Column of docs, holds and lang is not null.

    The rows of a language whose id hashes least are taken; a hash below a threshold, which twice per_language of its
    rows should pass, thins out each language before rows are ranked, so no language gathers in one task.
    """
    text = docs["text"].cast("string")
    named = docs.filter(training & docs["lang"].isNotNull() & text.isNotNull())
    named = named.select(docs["doc_id"].alias("id"), docs["lang"].cast("string").alias("lang"), F.struct(F.xxhash64(text), text.alias("text")).alias("t"))
    sizes = F.broadcast(named.groupBy("lang").agg((F.approx_count_distinct("id") + 1).alias("n")))  # a row for each language
    spread = (F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("id")), 11) / F.lit(2.0**53)) * F.col("n")
    ids = named.select("id", "lang").join(sizes, "lang").filter(spread <= 2 * per_language).select("id", "lang").distinct()
    # At most per_language ids of each language.
    chosen = F.broadcast(hash_sample(ids, "id", per_language, per="lang").select(F.col("id").alias("i"), F.col("lang").alias("l")))
    rows = named.join(chosen, F.col("id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")))
    rows = rows.groupBy("i", "l").agg(F.min("t").alias("t")).select(F.col("l").alias("lang"), F.col("t.text").alias("text"))  # repeated ids count once

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        found = [(languages[i], s) for i, t in enumerate(texts) for s in _segments(t, BUDGET)]
        out: list[tuple[str, int, int, int]] = []
        for lang in sorted({x for x, _ in found}):
            own = [s for x, s in found if x == lang]
            for a, b in pieces_of(own, BUDGET):
                w = words_of(own[a:b])
                for kind, values in ((0, w.grams[0]), (1, w.grams[1]), (2, np.repeat(w.script, w.letters))):
                    n = np.bincount(values)
                    used = np.flatnonzero(n)
                    out += zip([lang] * len(used), [kind] * len(used), used.tolist(), n[used].tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "kind", "bucket", "n"])

    counted = map_batches(rows, count, "lang string, kind int, bucket int, n bigint")
    total = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(total["lang"].unique().tolist())
    code = total["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    kind, bucket, n = (total[c].to_numpy(dtype=np.int64) for c in ("kind", "bucket", "n"))
    tables = []
    for k in (0, 1):
        counts = np.zeros((BUCKETS, len(languages)))
        counts[bucket[kind == k], code[kind == k]] = n[kind == k]
        probable = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)
        tables.append((0.5 * np.log(probable)).astype(np.float32))
    scripts = np.zeros((len(SCRIPTS) + 1, len(languages)))
    scripts[bucket[kind == 2], code[kind == 2]] = n[kind == 2]
    allowed = scripts > 0.01 * scripts.sum(axis=0)
    commonest = int(scripts.sum(axis=0).argmax()) if languages else 0
    return Model(languages, commonest, tuple(tables), allowed)


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of every row of docs; with_spans adds the spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of BUCKETS rows by languages
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    schema = "doc_id bigint, lang_pred string, score double, n_spans int"
    schema += ", spans array<struct<lang: string, first_word: int, n_words: int>>" * with_spans

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = label(shared.value, texts)
        columns = [
            batch.column("doc_id"),
            pa.array([x[0] for x in found], pa.string()),
            pa.array([x[1] for x in found], pa.float64()),
            pa.array([len(x[2]) for x in found], pa.int32()),
        ]
        if with_spans:
            spans = [[dict(zip(("lang", "first_word", "n_words"), s, strict=True)) for s in x[2]] for x in found]
            columns.append(pa.array(spans, pa.list_(span)))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_spans", "spans"][: len(columns)])

    return map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language holds at least a share of their letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = label(shared.value, texts)
            yield batch.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
