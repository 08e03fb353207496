"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII whitespace characters, the only ones that end a word.
WHITESPACE = " \t\n\x0b\x0c\r"

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = 0x9E3779B97F4A7C15
_SECOND_MULTIPLIER = 0xC2B2AE3D27D4EB4F


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character (accented ones too) unchanged."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bounded_arrow(spark: SparkSession, rows: int = 500) -> None:
    """At most ``rows`` rows in a batch sent to Python from now on: long
    texts then make batches of some MB, not of a task's whole memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_by_size(df: DataFrame, size: Column, per_part: int) -> tuple[int, int]:
    """(parts, total): how many parts of about ``per_part`` the summed
    ``size`` makes, at least one for each shuffle partition."""
    total = int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total")).first()["total"])
    return max(shuffle_partitions(df), -(-total // per_part), 1), total


_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def spaced(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and every ASCII character that is neither
    letter nor digit as a space."""
    return (text or "").encode("utf-8").lower().translate(_TO_SPACE)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return spaced(text).split()


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, computed once for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the whitespace-separated words of all texts in a row, and
    the offsets at which each text starts (one more than there are texts)."""
    cache = WordHashes()
    parts, offsets = [], [0]
    for text in texts:
        words = (text or "").encode("utf-8").split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        offsets.append(offsets[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.asarray(offsets, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h``, by doubling:
    a run of a + b is the run of a times M^b plus the run of b after it.
    ``second`` uses another multiplier: an independent check hash."""
    m = _SECOND_MULTIPLIER if second else _MULTIPLIER
    if len(h) < n:
        return np.empty(0, np.uint64)
    done, out = 0, None
    run, width = h, 1
    while True:
        if n & width:
            if out is None:
                out, done = run, width
            else:
                power = np.uint64(pow(m, width, 1 << 64))
                size = len(h) - done - width + 1
                out, done = out[:size] * power + run[done : done + size], done + width
        if done == n:
            return mix(out)
        power = np.uint64(pow(m, width, 1 << 64))
        run = run[:-width] * power + run[width:]
        width *= 2


def window_starts(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over ``rolling(h, n)``: the runs that stay inside one text."""
    size = max(0, total - n + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:size]
    return np.arange(size) + n <= ends


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def bucket_edges(sorted_values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of ``bits``-bit values starts
    in ``sorted_values`` (one more than there are buckets)."""
    starts = [min((b << bits) // buckets, (1 << 64) - 1) for b in range(buckets)]
    inner = np.searchsorted(sorted_values, np.asarray(starts, np.uint64), side="left")
    return np.append(inner, len(sorted_values))


def groups_of(ordered: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Start of each run of equal entries in sorted arrays."""
    if not len(ordered):
        return np.empty(0, np.int64)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def member_of(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def small_batches(batch, column: str = "text", limit: int = 4_000_000) -> Iterator:
    """Slices of an Arrow record batch of about ``limit`` bytes of text, so
    that a batch of very long texts does not multiply a task's memory."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    start, size = 0, 0
    for i, n in enumerate(lengths.to_pylist()):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
