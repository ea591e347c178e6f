"""Helpers that several operators share: tables, shared folders, vectorised words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: One slice of texts that numpy works on at a time. A longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_at(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors. With the folder it is in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    return keep_at(df, name, partition_by)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that keep_at wrote and nothing reads any more."""
    if not path.startswith(f"{shared_dir(spark)}/gridloom/"):
        raise ValueError(f"{path} is not ours")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Sum of the UTF-8 bytes of a column: decides how many groups an operator deals into."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def words_count(text: F.Column) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# -- vectorised words -------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POW["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _POW[k] = np.multiply.accumulate(out)
    return _POW["up"][:n], _POW["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def slices(texts: pa.Array, cap: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of at most cap bytes (a longer row alone), as bytes; null counts as empty."""
    rows, size, first = [], 0, 0
    for i, t in enumerate(texts.cast(pa.large_binary())):
        b = t.as_py() or b""
        if rows and size + len(b) > cap:
            yield first, rows
            rows, size, first = [], 0, i
        rows.append(b)
        size += len(b) + 1
    if rows:
        yield first, rows


def word_codes(rows: list[bytes], lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of a slice of documents as codes into their dictionary (binary), the dictionary, and where each document's words begin (and the end).

    Words are told apart byte by byte. lower puts A-Z in lower case first.
    """
    joined = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    sizes = np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))
    first = np.searchsorted(edge[0::2], np.concatenate(([0], np.cumsum(sizes))))
    if not len(edge):
        return np.empty(0, np.int64), pa.array([], pa.large_binary()), first
    # words and what is between them take turns in one array; every other value is a word
    both = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(joined)])
    coded = both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, first


def word_hashes(rows: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a slice of documents, in order, and where each document's words begin (and the end).

    Words are told apart byte by byte. A distinct one of up to 64 bytes is
    hashed by stretch_hashes (one of up to 8 bytes like no other of its
    length), a longer one by BLAKE2: no pattern of letters makes two words alike.
    """
    codes, dictionary, first = word_codes(rows, lower)
    if not len(dictionary):
        return np.empty(0, np.uint64), first
    _, at, data = dictionary.buffers()
    at = np.frombuffer(at, np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    starts, widths = at[:-1], np.diff(at)
    prints = np.empty(len(dictionary), np.uint64)
    short = np.flatnonzero(widths <= 64)
    if len(short):
        prints[short] = stretch_hashes(np.frombuffer(data, np.uint8), starts[short], widths[short])
    for k in np.flatnonzero(widths > 64).tolist():
        prints[k] = int.from_bytes(hashlib.blake2b(dictionary[k].as_py(), digest_size=8, key=b"words").digest(), "little")
    return prints[codes], first


def stretch_hashes(data: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: eight bytes at a time are mixed in, not added up, so no pattern of bytes cancels out."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    room = -(-int(widths.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(room, np.uint8))), room)  # a view: row i begins at byte i
    at = np.arange(room, dtype=np.int32)
    for lo in range(0, len(starts), 1 << 13):  # few enough for the cache
        s, w = starts[lo : lo + (1 << 13)], widths[lo : lo + (1 << 13)]
        block = rows[s]
        block *= at < w[:, None].astype(np.int32)  # zeros behind the stretch
        h = mix(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k, word in enumerate(np.ascontiguousarray(block).view(np.uint64).T):
            # as many steps as the stretch has words: what stands beside it changes nothing
            h = np.where(8 * k < w, mix((h ^ word) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), h)
        out[lo : lo + len(s)] = h
    return out


class Words:
    """The words of a slice of documents: 64-bit hashes in order, and where each document's words begin. For features only: the hashes are linear, and words can be made that share one."""

    def __init__(self, rows: list[bytes], lower: bool = True):
        joined = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
        if lower:
            joined = _LOWER[joined]
        space = _SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        up, down = powers(len(joined))
        total = np.empty(len(joined) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[joined] * up, out=total[1:])
        self.starts, self.ends, self._total, self._down = starts, ends, total, down
        self.hash = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        sizes = np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))
        self.first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The words longer than so many bytes (their places in order), and hashes of their beginnings."""
        at = np.flatnonzero(self.ends - self.starts > length)
        s = self.starts[at]
        return at, mix((self._total[s + length] - self._total[s]) * self._down[s] + np.uint64(length + (1 << 40)))
