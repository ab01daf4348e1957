"""Byte-level BPE encoding and decoding.

Encoding: the merges are compiled into a finite-state transducer over bytes. Its nondeterministic form guesses where
tokens end: a guess is (place in the trie of tokens, token before it, tokens not written yet), and a token may follow
another exactly if merging the bytes of both gives these two tokens again. Its deterministic form is made lazily: a
state is the set of guesses still alive, less the tokens that all of them share, which are written as soon as they are
shared. A guess lives no longer than the longest token, so the lookahead is bounded. States and steps are kept in a
table that is emptied when it holds ``MAX_STEPS`` states and then filled again as needed.

Decoding: a stream of ids goes through an incremental UTF-8 machine whose state is the unfinished character; it hands
out whole characters as they are completed, and raw bytes where they are no UTF-8.

Every match of the split pattern is encoded separately; ``pieces`` keeps the ids of pieces met before.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from kohort.llm.arrow_text import slices, small_batches, unused
from kohort.llm.pieces import MAX_ENTRIES, SLICE, PieceTable, gather

MAX_STEPS = 80_000
_ROOT = 0


def read_ranks(path: str) -> bytes:
    """The rank file (a line per token: base64 bytes, rank). Its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


class Transducer:
    """Bytes in, token ids out; see the module's text."""

    def __init__(self, rank_file: bytes, max_states: int | None = None):
        self.max_states = max_states or MAX_STEPS
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.inner = [True]
        for token, rank in self.ranks.items():
            node = _ROOT
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token_at[node] = rank
        self.follows: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None | bool] = {}
        self.emptied = 0
        self._empty()

    def _empty(self) -> None:
        start = ((_ROOT, -1, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.emptied += 1
        self.steps: dict[int, tuple[tuple[int, ...], int]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, merged by rank, give these two tokens (left -1: right alone gives itself)."""
        key = (left + 1) << 32 | right
        known = self.follows.get(key)
        if known is None:
            if self._made_of(right) is False or left >= 0 and self._made_of(left) is False:
                known = self._keeps(self.bytes_of[left] if left >= 0 else b"", self.bytes_of[right])
            else:
                known = left < 0 or self._apart(left, right)
            if len(self.follows) >= 4 * self.max_states:
                self.follows.clear()
            self.follows[key] = known
        return known

    def _made_of(self, token: int) -> tuple[int, int] | None | bool:
        """The two tokens whose merge gives this one, all made by lower ranks; None for a byte, False if it is not made so."""
        known = self.parts.get(token, True)
        if known is True:
            text = self.bytes_of[token]
            known = None
            if len(text) > 1:
                halves = [self.ranks.get(x) for x in self._merged(text, token)]
                known = len(halves) == 2 and self._made_of(halves[0]) is not False and self._made_of(halves[1]) is not False and max(halves) < token and tuple(halves)
            self.parts[token] = known
        return known

    def _merged(self, text: bytes, below: int) -> list[bytes]:
        """The parts that merges of lower ranks than ``below`` leave."""
        parts = [bytes((x,)) for x in text]
        while True:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, x: int, y: int) -> bool:
        """Whether no merge ever joins the end of ``x`` to the start of ``y``.

        Goes back in time: the merge made last is undone, and the two parts that touch then would have been joined if
        their rank came before it. Of two equal merges the left one is done first.
        """
        ranks, text, limit = self.ranks, self.bytes_of, len(self.bytes_of) + (1 << 40)
        while True:
            joined = ranks.get(text[x] + text[y])
            if joined is not None and joined < limit:
                return False
            of_x, of_y = self._made_of(x), self._made_of(y)
            if of_x is not None and (of_y is None or x > y):
                x, limit = of_x[1], x
            elif of_y is not None:
                y, limit = of_y[0], y + 1
            else:
                return True

    def _keeps(self, a: bytes, b: bytes) -> bool:
        """The same for any two byte strings, by merging them."""
        parts = [bytes((x,)) for x in a + b]
        cut, ranks = len(a), self.ranks
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return len(parts) == (2 if a else 1)
            end = sum(map(len, parts[: at + 1]))
            if a and end == cut:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        alive, done = [], None
        child, inner = self.child, self.inner
        for node, before, pending in self.states[state]:
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                continue
            if done is None:
                token = self.token_at[nxt]
                if token >= 0 and self.may_follow(before, token):
                    done = (_ROOT, token, (*pending, token))
            if inner[nxt]:
                alive.append((nxt, before, pending))
        if done is None:
            raise ValueError("the rank file lacks a byte")
        shared = done[2]
        for _, _, pending in alive:
            if pending[: len(shared)] != shared:
                k = 0
                while k < len(pending) and k < len(shared) and pending[k] == shared[k]:
                    k += 1
                shared = shared[:k]
        alive.append(done)
        cut = len(shared)
        target = tuple((n, t, p[cut:]) for n, t, p in alive) if cut else tuple(alive)
        if len(self.states) >= self.max_states:
            self._empty()
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
        return shared, number

    def encode_sorted(self, inputs: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Token ids of each input, each one match of the split pattern. Sorted inputs share the steps of their common starts."""
        path: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        last, emptied = b"", self.emptied
        for data in inputs:
            k = 0
            if emptied == self.emptied:
                for a, b in zip(last, data, strict=False):
                    if a != b:
                        break
                    k += 1
            emptied, last = self.emptied, data
            del path[k + 1 :]
            state, out = path[-1]
            for b in data[k:]:
                key = state << 8 | b
                hit = self.steps.get(key)
                if hit is None:
                    before = self.emptied
                    hit = self._step(state, b)
                    if before == self.emptied:
                        self.steps[key] = hit
                state = hit[1]
                if hit[0]:
                    out += hit[0]
                path.append((state, out))
            yield out + self.states[state][-1][2]

class Utf8Machine:
    """Takes bytes in any portions; gives back whole characters, and bytes that are no UTF-8 as they are."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _wanted(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    @staticmethod
    def _fits(held: bytes, byte: int) -> bool:
        """Whether ``byte`` may follow the unfinished character ``held``."""
        if len(held) == 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(held[0], (0x80, 0xBF))
            return low <= byte <= high
        return 0x80 <= byte <= 0xBF

    def feed(self, data: bytes) -> bytes:
        out = bytearray()
        for b in data:
            if self.held and not self._fits(self.held, b):
                out += self.held
                self.held = b""
            self.held += bytes((b,))
            if len(self.held) >= self._wanted(self.held[0]):
                out += self.held
                self.held = b""
        return bytes(out)

    def close(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


class Codec:
    """Texts to ids and back, with bounded tables of what was met before."""

    def __init__(self, rank_file: bytes, pattern: str, max_states: int | None = None, max_pieces: int | None = None):
        self.fst = Transducer(rank_file, max_states)
        self.pattern = regex.compile(pattern)
        self.pieces = PieceTable(self._pieces, max_pieces or MAX_ENTRIES)
        vocabulary = self.fst.bytes_of
        self.table = [vocabulary.get(i, b"") for i in range(max(vocabulary, default=0) + 1)]
        self.whole = np.array([self._is_whole(t) for t in self.table], dtype=bool)
        self.blob = np.frombuffer(b"".join(self.table), dtype=np.uint8)
        self.size = np.array([len(t) for t in self.table], dtype=np.int64)
        self.place = np.cumsum(self.size) - self.size
        shown = [b"%d " % i for i in range(len(self.table))]
        self.digit_size = np.array([len(t) for t in shown], dtype=np.int64)
        wide = int(self.digit_size.max(initial=1))
        self.digits = np.frombuffer(b"".join(t.ljust(wide) for t in shown), dtype=np.uint8).reshape(-1, wide)
        self.digit_used = np.arange(wide) < self.digit_size[:, None]

    @staticmethod
    def _is_whole(token: bytes) -> bool:
        try:
            token.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return Utf8Machine().feed(token) == token

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        find, cut = self.pattern.findall, []
        for piece in pieces:
            text = piece.decode("utf-8", "surrogatepass")
            body = text[1:] if text[0] == " " else text
            cut.append((piece,) if body.isalpha() else tuple(m.encode("utf-8", "surrogatepass") for m in find(text)))
        distinct = sorted({m for ms in cut for m in ms})
        known = dict(zip(distinct, self.fst.encode_sorted(distinct), strict=True))
        got = [known[m] for ms in cut for m in ms]
        matches = np.fromiter(map(len, cut), np.int64, len(cut))
        sizes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))))
        ends = np.cumsum(matches)
        return np.fromiter(chain.from_iterable(got), np.int32, int(sizes[-1])), sizes[ends] - sizes[ends - matches]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and each row's number of ids."""
        return self.pieces.ids(raw, off)

    def shown(self, ids: np.ndarray) -> np.ndarray:
        """Decimal numbers, each followed by a space, as bytes; the sizes are ``digit_size[ids]``."""
        return self.digits[ids][self.digit_used[ids]]

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """Whole characters, in portions. Runs of tokens that hold whole characters only pass the machine by."""
        size = self.size[ids]
        raw = self.blob[gather(self.place[ids], size)].tobytes()
        broken = ~self.whole[ids]
        if not broken.any():
            yield raw
            return
        turn = np.flatnonzero(broken[1:] != broken[:-1]) + 1
        at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], turn, [len(ids)]))].tolist()
        machine, through = Utf8Machine(), bool(broken[0])
        for a, b in pairwise(at):
            if through:
                yield machine.feed(raw[a:b])
            else:
                yield machine.close() + raw[a:b]  # a whole character never completes an unfinished one
            through = not through
        yield machine.close()


_codecs: dict[bytes, Codec] = {}


def codec(rank_file: bytes, pattern: str, max_states: int | None = None, max_pieces: int | None = None) -> Codec:
    """One codec per worker, kept between tasks."""
    key = hashlib.sha256(rank_file + pattern.encode() + b"%d %d" % (max_states or 0, max_pieces or 0)).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern, max_states, max_pieces)
    return _codecs[key]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "token_ids", keep: list[str] | None = None, max_states: int | None = None, max_pieces: int | None = None) -> DataFrame:
    """``keep`` (all columns) plus ``out``, the ids as array<int>, and ``n_tokens``. No shuffle; row by row.

    A null or empty text gives no ids; columns of the same names as the new ones are replaced. ``max_states`` and
    ``max_pieces`` bound the tables of a worker: smaller ones take less memory and more time, and give the same ids.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (out, "n_tokens")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused("_text", keep)))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        coder = codec(ranks.value, pattern, max_states, max_pieces)
        for batch in batches:
            for a, b, raw, off in slices(batch.column(batch.num_columns - 1), SLICE):
                ids, counts = coder.encode(raw, off)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns = batch.slice(a, b - a).columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(counts)], names=[*keep, out, "n_tokens"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have 0 tokens and the hash of nothing; a null id stays null; repeated rows stay repeated; an
    empty table gives an empty one; other columns play no part.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        coder = codec(ranks.value, pattern)
        for batch in batches:
            for a, b, raw, off in slices(batch.column(1), SLICE):
                ids, counts = coder.encode(raw, off)
                ends = np.concatenate(([0], np.cumsum(counts)))
                shown = memoryview(coder.shown(ids))
                widths = np.concatenate(([0], np.cumsum(coder.digit_size[ids])))[ends]
                of_ids = [hashlib.sha256(shown[x : max(x, y - 1)]).hexdigest() for x, y in pairwise(widths.tolist())]
                of_text = []
                for x, y in pairwise(ends.tolist()):
                    digest = hashlib.sha256()
                    for portion in coder.decode(ids[x:y]):
                        digest.update(portion)
                    of_text.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
