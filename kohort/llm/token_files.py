"""Token ids in Arrow files of equal-length sequences, for random access without copies.

A file is an Arrow IPC file whose record batches all have ``ROWS`` sequences (the last may have fewer). Columns: ``input_ids``,
fixed-size lists of ``length`` ids (uint16 if the vocabulary fits, else uint32), and ``mask``, as many booleans; false marks the
padding behind a file's last id. Sequence s of a file is row s % ROWS of batch s // ROWS, and id t is at place t % length of
sequence t // length, so a reader that maps the file into memory gets any sequence as a view.

Documents are dealt by ranges of their id and sorted, so that files follow one another in ascending order of id; each task
writes one file, under a name of its own, to a folder that all executors reach. The index, a row for each document, names the
file that the finished task wrote; a lost task's file is in no index. The first ids of files are running sums over the files.

Null and empty texts have only the end id; rows with a null id come first; repeated rows are written again; an empty table
gives no file; other columns play no part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from kohort.llm.arrow_text import slices
from kohort.llm.pieces import SLICE, PieceTable
from kohort.session import shared_folder, stage_table

LENGTH = 2048
ROWS = 64
END = 0
_tables: dict[str, PieceTable] = {}


def piece_table(tokenizer_path: str) -> PieceTable:
    """Pieces and their ids under the tokenizer, kept between the tasks of a worker."""
    if tokenizer_path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            out = []
            for k in range(0, len(pieces), 8192):
                got = tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in pieces[k : k + 8192]], add_special_tokens=False)
                out += [e.ids for e in got]
            sizes = np.fromiter(map(len, out), np.int64, len(out))
            return np.fromiter(chain.from_iterable(out), np.int32, int(sizes.sum())), sizes

        _tables.clear()
        _tables[tokenizer_path] = PieceTable(encode)
    return _tables[tokenizer_path]


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


class TokenWriter:
    """Takes ids in portions and writes full batches as they come together."""

    def __init__(self, uri: str, length: int = LENGTH, rows: int = ROWS, kind: pa.DataType | None = None):
        self.length, self.rows, self.kind = length, rows, kind or pa.uint16()
        files, path = pafs.FileSystem.from_uri(uri) if _local(uri) is None else (pafs.LocalFileSystem(), _local(uri))
        files.create_dir(os.path.dirname(path), recursive=True)
        self.sink = files.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, file_schema(length, self.kind))
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n += len(ids)
        size = self.length * self.rows
        if self.n >= size:
            flat = np.concatenate(self.held)
            whole = self.n // size * size
            for k in range(0, whole, size):
                self._write(flat[k : k + size], size)
            self.held, self.n = [flat[whole:]], self.n - whole

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.file_schema))

    @property
    def file_schema(self) -> pa.Schema:
        return file_schema(self.length, self.kind)

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-self.n // self.length) * self.length, dtype=flat.dtype)
            padded[: self.n] = flat
            self._write(padded, self.n)
        self.file.close()
        self.sink.close()


class TokenFile:
    """Random access; sequences and masks are views of the mapped file (of the bytes read, in a remote store)."""

    def __init__(self, uri: str):
        path = _local(uri)
        if path is not None:
            self.source = pa.memory_map(path)
        else:
            files, path = pafs.FileSystem.from_uri(uri)
            self.source = files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.batches else 0

    def batch_ids(self, k: int) -> np.ndarray:
        """All ids of a batch, padding included, as a view."""
        return self.reader.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)

    def sequence(self, s: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence s."""
        k, r = divmod(s, self.rows)
        mask = self.reader.get_batch(k).column(1).values.slice(r * self.length, self.length)
        return self.batch_ids(k)[r * self.length : (r + 1) * self.length], mask

    def span(self, start: int, n: int) -> list[np.ndarray]:
        """The ids [start, start + n) of the file, as views of the batches they lie in."""
        size, out = self.length * self.rows, []
        while n > 0:
            k, at = divmod(start, size)
            part = self.batch_ids(k)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end: int = END, length: int = LENGTH, rows: int = ROWS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files; gives the index: doc_id, file, start (ids of all documents before), place (the same within the file), n_tokens."""
    folder = (folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    dealt = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        coder, out, uri, place, kind = piece_table(tokenizer_path), None, None, 0, pa.uint16()
        for batch in batches:
            if batch.num_rows and out is None:
                from tokenizers import Tokenizer

                kind = pa.uint16() if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else pa.uint32()
                uri = f"{folder}/{uuid.uuid4().hex}.arrow"
                out = TokenWriter(uri, length, rows, kind)
            for a, b, raw, off in slices(batch.column(1), SLICE):
                ids, counts = coder.ids(raw, off)
                ends = np.cumsum(counts)
                out.add(np.insert(ids, ends, end))
                counts = counts + 1
                places = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([uri] * (b - a), pa.string()), pa.array(places), pa.array(counts)], names=["doc_id", "file", "place", "n_tokens"])
        if out is not None:
            out.close()

    index = stage_table(dealt.mapInArrow(run, "doc_id long, file string, place long, n_tokens long"), "token-index")
    files = index.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("last").asc_nulls_first(), F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return index.join(offsets, "file").select("doc_id", "file", (F.col("offset") + F.col("place")).alias("start"), "place", "n_tokens")


def token_digests(index: DataFrame) -> DataFrame:
    """Read every document's ids back from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def run(batches):
        at, file = None, None
        for batch in batches:
            crc = []
            for uri, place, n in zip(*[batch.column(c).to_pylist() for c in ("file", "place", "n_tokens")], strict=True):
                if uri != at:
                    at, file = uri, TokenFile(uri)
                value = 0
                for part in file.span(place, n):
                    value = zlib.crc32(part.astype("<u4").tobytes(), value)
                crc.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.repartition("file").sortWithinPartitions("file", "place").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
