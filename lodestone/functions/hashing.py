"""Hashes, checksums, URL forms and hashed vectors as Columns."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .text import STOP_CACHE, let, squeeze, tokenize_words

# Fixed value: query parameters that only track.
TRACKING = r"(?i)^(utm_|gclid|fbclid|mc_|ref$|ref_|igshid)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash, no tracking parameters, the others sorted, no fragment."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*)?([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    start = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(path == "", "/").otherwise(path))
    return F.when(F.size(pairs) > 0, F.concat(start, F.lit("?"), F.array_join(pairs, "&"))).otherwise(start)


def cache_key(prompt: Column) -> Column:
    return F.sha2(squeeze(F.lower(prompt)), 256)


SALT = "rag-ingest-salt-v1"  # fixed value


def pii_placeholder(kind: str, value: Column, salt: str = SALT) -> Column:
    """[KIND_xxxxxx] from a salted hash of the value's digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"[{kind}_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), digits), 256), 1, 6), F.lit("]"))


def luhn_valid(number: Column) -> Column:
    """Luhn's check over 13 digits or more."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).try_cast("int")
        double = d * 2
        return F.when((F.length(digits) - i) % 2 == 1, double - F.when(double > 9, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(places, worth), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return (F.length(digits) >= 13) & (total % 10 == 0)


def dihedral_tables() -> tuple[list[int], list[int]]:
    """Verhoeff's tables, each row after row: products in the dihedral group of ten, and powers of his permutation."""

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value
    row, rows = list(range(10)), []
    for _ in range(8):
        rows += row
        row = [step[x] for x in row]
    return [product(a, b) for a in range(10) for b in range(10)], rows


def verhoeff_valid(number: Column) -> Column:
    """Verhoeff's check over exactly 12 digits."""
    product, power = (F.array(*map(F.lit, t)) for t in dihedral_tables())
    digits = F.regexp_replace(number, "[^0-9]", "")
    places = F.sequence(F.lit(0), F.lit(11))

    def fold(c: Column, i: Column) -> Column:
        d = F.coalesce(F.substr(digits, F.lit(12) - i, F.lit(1)).try_cast("int"), F.lit(0))
        return F.element_at(product, c * 10 + F.element_at(power, (i % 8) * 10 + d + 1) + 1)

    return (F.length(digits) == 12) & (F.aggregate(places, F.lit(0), fold) == 0)


def embedded_words(text: Column) -> Column:
    """The words that hash_embed counts."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(STOP_CACHE))


def hashed(words: pa.ListArray, known: dict[str, int], dim: int) -> np.ndarray:
    """The vectors of unit length of lists of words; known keeps words' places."""
    if len(known) > 1_000_000:
        known.clear()
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    found = coded.dictionary.to_pylist()
    for w in found:
        if w not in known:
            known[w] = int(hashlib.md5(w.encode()).hexdigest()[-2:], 16) & (dim - 1)
    place = np.array([known[w] for w in found], np.int64)[coded.indices.to_numpy()]
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dim + place, minlength=len(sizes) * dim).reshape(-1, dim)
    length = np.sqrt((counts * counts).sum(axis=1).astype(float))
    return counts / np.where(length > 0, length, 1.0)[:, None]


def hash_embed(rows: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """(key, v): bag of words hashed by md5 into a power-of-two number of places, of unit length; stop words left out.

    Words are cut by the JVM and counted in Arrow batches, a row at its place, so nothing is shuffled. A text without
    words, or a null one, has the zero vector.
    """
    if dim & (dim - 1) or dim > 256:
        raise ValueError("dim must be a power of two, 256 at most")

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            v = hashed(batch.column(1), known, dim)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1)))], [key, "v"])

    cut = rows.select(key, F.coalesce(embedded_words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    return cut.mapInArrow(run, StructType([cut.schema[0], StructField("v", ArrayType(DoubleType()))]))


def minhash_signature(shingles: Column, permutations: int = 64) -> Column:
    """Least first 16 hex digits of md5('seed:shingle') for each seed; hex of one width orders like unsigned numbers."""
    seeds = F.sequence(F.lit(0), F.lit(permutations - 1))

    def sign(found: Column) -> Column:
        return F.transform(seeds, lambda s: F.array_min(F.transform(found, lambda x: F.substring(F.md5(F.concat(s.cast("string"), F.lit(":"), x)), 1, 16))))

    return let(shingles, sign)


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_PLACES = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _md5_block(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """One block of MD5 for many messages: words are the block's 16 with the sine of each of the 64 steps added."""
    a, b, c, d = (x.copy() for x in state)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif kind == 1:
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif kind == 2:
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        turn = int(_TURNS[kind, i % 4])
        np.add(a, t, out=a), np.add(a, words[i], out=a)
        np.left_shift(a, np.uint32(turn), out=u), np.right_shift(a, np.uint32(32 - turn), out=a), np.bitwise_or(a, u, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _least_md5(data: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray, rows: int, permutations: int, at_once: int = 32_768) -> np.ndarray:
    """(permutations x rows) least first 8 bytes of md5('seed:piece') over the pieces data[start : start + size] of a row; row rises."""
    least = np.full((permutations, rows), np.iinfo(np.uint64).max)
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for digits in range(1, len(str(permutations - 1)) + 1):
        seeds = [s for s in range(permutations) if len(str(s)) == digits]
        blocks = (size + digits + 1 + 8) // 64 + 1
        for n in np.unique(blocks).tolist():
            of = np.nonzero(blocks == n)[0]
            step = max(1, at_once // n)
            for a in range(0, len(of), step):
                mine = of[a : a + step]
                long = size[mine]
                text = np.zeros((len(mine), 64 * n), np.uint8)
                flat = np.repeat(np.arange(len(mine)) * 64 * n + digits + 1 - (np.cumsum(long) - long), long) + np.arange(long.sum())
                text.reshape(-1)[flat] = data[np.repeat(start[mine] - (np.cumsum(long) - long), long) + np.arange(long.sum())]
                text[np.arange(len(mine)), long + digits + 1] = 0x80
                text.view("<u8")[:, -1] = (long + digits + 1) * 8
                word = np.ascontiguousarray(text.view("<u4").T)
                with np.errstate(over="ignore"):
                    ready = [[word[16 * k + _PLACES[i]] + _SINES[i] for i in range(64)] for k in range(n)] if n <= 4 else None
                    runs = np.r_[0, np.nonzero(np.diff(row[mine]))[0] + 1]
                    at = row[mine][runs]
                    for seed in seeds:
                        mark = int.from_bytes(f"{seed}:".encode(), "little")  # up to four bytes, in the first word; it has none of the piece there
                        state = [np.full(len(mine), x, np.uint32) for x in first]
                        for k in range(n):
                            now = list(ready[k]) if ready else [word[16 * k + _PLACES[i]] + _SINES[i] for i in range(64)]
                            if k == 0:
                                for i in (i for i in range(64) if _PLACES[i] == 0):
                                    now[i] = now[i] + np.uint32(mark)
                            state = _md5_block(state, now)
                        key = state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()
                        least[seed, at] = np.minimum(least[seed, at], np.minimum.reduceat(key, runs))
    return least


def minhash_documents(rows: DataFrame, key: str, text: str = "text", k: int = 5, permutations: int = 64) -> DataFrame:
    """(key, signature): minhash_signature of the k-word shingles of each text, by MD5 over many shingles at a time.

    Texts go to Python as their words with one space between, of which a shingle is a stretch; a null text has an empty
    signature.
    """
    if permutations > 1_000:
        raise ValueError("permutations must be 1,000 at most")

    def run(batches):
        for whole in batches:
            ends, a = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while a < whole.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 4_000_000, "right")))
                batch, a = whole.slice(a, b - a), b
                texts = [x.as_py() for x in batch.column(1)]
                given = np.array([x is not None for x in texts], bool)
                joined = b"".join(x.encode() + b" " for x in texts if x is not None)
                data = np.frombuffer(joined, np.uint8)
                words = np.array([x.count(" ") + 1 for x in texts if x is not None], np.int64)  # a text without words counts as one, empty
                stop = np.nonzero(data == 32)[0]
                begin = np.r_[0, stop[:-1] + 1] if len(stop) else stop
                many = np.maximum(words - k + 1, 1)
                row = np.repeat(np.arange(len(words)), many)
                head = np.repeat(np.cumsum(words) - words - (np.cumsum(many) - many), many) + np.arange(many.sum())
                last = np.minimum(head + k - 1, np.repeat(np.cumsum(words) - 1, many)) if len(words) else head
                least = _least_md5(data, begin[head], stop[last] - begin[head], row, len(words), permutations)
                digits = np.frombuffer(least.T.astype(">u8").tobytes().hex().encode(), np.uint8)
                found = pa.StringArray.from_buffers(least.size, pa.py_buffer(np.arange(least.size + 1, dtype=np.int32) * 16), pa.py_buffer(digits))
                offsets = np.r_[0, np.cumsum(given * permutations)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), found)], [key, "signature"])

    cut = rows.select(key, F.array_join(tokenize_words(F.col(text)), " ").alias("words"))
    return cut.mapInArrow(run, StructType([cut.schema[0], StructField("signature", ArrayType(StringType()))]))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures: the estimated Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
