"""Arrow batches as flat byte buffers, and vectorised word and window hashing over them.

Tasks never hold more than one slice of a batch (``SLICE_BYTES`` of text, or a single longer text) beside the batch
itself, so the memory of a task does not follow its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: An odd base and its inverse modulo 2**64, for hashes of byte strings by differences of prefix sums.
_BASE = 0x5851F42D4C957F2D | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, and the same with A-Z equal to a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_fold = np.arange(256)
_fold[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[_fold]
#: White space: tab to carriage return, and space.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: An addend for each place in a run of words.
_STEPS = np.arange(1, 65, dtype=np.uint64) * _GOLDEN


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table asked for so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(1 << max(16, int(n - 1).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def small_batches(spark, rows: int = 1000) -> None:
    """Send at most ``rows`` rows at a time to Python in this session: rows with whole texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` is called so."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def release() -> None:
    """Give memory that is free again back to the system; workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def portions(batches, rows: int = 500):
    """The batches in pieces of a few rows, for work that makes Python objects of them."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    release()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(arr) else raw[:0], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most ``limit`` bytes, or one longer row."""
    raw, off = texts(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    if n > 100:
        release()


def prefix_hash(raw: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``raw``."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * powers(_BASE, len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def words(raw: np.ndarray, off: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes inside one row that are not ``apart``), and the first word of each row.

    The third array has one entry more than there are rows.
    """
    solid = ~apart[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def runs_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; shorter than ``hashes`` by n - 1."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out += mix(hashes[k : k + m] + _STEPS[k])
    return mix(out)
