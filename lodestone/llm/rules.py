"""Quality rules: word counts, repetition, and compression bands.

A text whose zstandard ratio (bytes before to bytes after) lies above its band is repetitive; below it, incompressible.
Bands depend on length, as short texts compress less: see BANDS. Long texts are also judged in fixed chunks, so that a
bad stretch does not hide behind the rest: each chunk has the band of its own length, and a text is rejected when bad
chunks hold more than a share of it.

Results for odd input: null and empty texts, and texts of blanks only, have no words and fail the base rules; repeated
rows are judged each; columns of any name are carried along.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_batches, slices

SYMBOLS = "#*$%&|<>"
#: (bytes up to which the band holds, least ratio, greatest ratio), for the library's level 3: what fit_bands() gave for
#: 3,409 documents labelled good, whose 0.1 % and 99.9 % quantiles were 1.38 to 1.72, 1.42 to 1.96, 1.73 to 2.15, 2.04 to
#: 2.35 and 2.25 to 2.48 in the five lengths; the last band's upper end is wider, as ratios go on growing with length.
BANDS = (
    (400, 1.24, 2.06),
    (1_000, 1.28, 2.35),
    (3_000, 1.56, 2.58),
    (10_000, 1.84, 2.82),
    (float("inf"), 2.02, 3.5),
)
#: What fit_bands() leaves below and above the quantiles.
MARGIN = (0.9, 1.2)
CHUNK = 8_192
BAD_SHARE = 0.25
#: Characters split into words at once.
STRETCH = 1 << 20

_SPACES = tuple(" \t\n\x0b\x0c\r")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def ratio(packer: zstandard.ZstdCompressor, raw: bytes) -> float:
    return len(raw) / len(packer.compress(raw)) if raw else 0.0


def outside(value: float, size: int) -> bool:
    low, high = next((a, b) for top, a, b in BANDS if size <= top)
    return not low <= value <= high


def word_numbers(raw: bytes) -> np.ndarray:
    """The number of each word among the distinct words, in the text's order; a stretch of the text is split at a time."""
    numbers: dict[bytes, int] = {}
    out, at = [], 0
    while at < len(raw):
        end = at + STRETCH
        if end < len(raw) and (blank := _BLANK.search(raw, end)):
            end = blank.start()
        elif end < len(raw):
            end = len(raw)
        words = raw[at:end].split()
        out.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_words(words: np.ndarray) -> int:
    """Words, by number, that lie in a 3-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    top = int(words.max()) + 1
    pairs = np.unique(words[:-1] * top + words[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1].astype(np.int64) * top + words[2:], return_inverse=True, return_counts=True)
    if len(counts) == len(inverse):
        return 0
    starts = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.encode("utf-8").strip():
            n += line in seen
            seen.add(line)
    return n


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunk_share)."""
    text = text or ""
    raw = text.encode("utf-8")
    words = word_numbers(raw)
    n_repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    whole = ratio(packer, raw)
    bad = 0
    if len(raw) > CHUNK:
        # A short last chunk joins the one before it.
        starts = list(range(0, len(raw) - CHUNK // 2, CHUNK))
        for a, b in zip(starts, [*starts[1:], len(raw)], strict=True):
            part = raw[a:b]
            bad += len(part) * outside(ratio(packer, part), len(part))
    share = bad / len(raw) if raw else 0.0
    kept = not failed and not outside(whole, len(raw)) and share <= BAD_SHARE
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        repeated_lines(text),
        n_repeat,
        failed,
        kept,
        whole,
        share,
    )


def fit_bands(texts: list[str | None]) -> list[tuple[float, float, float]]:
    """Bands for the lengths of BANDS from texts that should stay: their 0.1 % and 99.9 % quantiles, and MARGIN."""
    packer = zstandard.ZstdCompressor(level=3)
    raws = [t.encode("utf-8") for t in texts if t]
    out, low = [], 0.0
    for top, *old in BANDS:
        found = [ratio(packer, r) for r in raws if low < len(r) <= top]
        ends = np.quantile(found, [0.001, 0.999]) * MARGIN if found else old
        out.append((top, round(float(ends[0]), 2), round(float(ends[1]), 2)))
        low = top
    return out


COLUMNS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "zstd_ratio": pa.float64(),
    "bad_chunk_share": pa.float64(),
}


def judge_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, COLUMNS) of every row of docs, one row for each."""
    types = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = "doc_id bigint, " + ", ".join(f"{n} {types[t]}" for n, t in COLUMNS.items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=3)
        rows = [judge(t.as_py(), packer) for t in batch.column("text")]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COLUMNS])

    return map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    names = docs.columns

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            kept = [judge(t.as_py(), packer)[6] for t in batch.column("text")]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)
