"""Byte-level BPE by tree reduction over a file of token ranks.

Encodings form a monoid: two encoded neighbours join to the encoding of their bytes. A
piece of text is encoded in halves; where the halves meet, a window of tokens around the
seam is encoded anew and grows until it fits what is left outside on either side.

Two tokens fit if the encoding of their bytes is these two again. Tokens of which all
neighbours fit are the encoding of their bytes: take the first merge of the whole that
crosses a seam of theirs. All merges before it stayed inside tokens, so around this seam
the whole has done just what the two tokens beside it do alone, and would be merged
across there too; but they fit. So nothing outside a fitting window can change.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarryline.llm.batches import pieces

#: Largest file of ranks that is broadcast.
MAX_FILE_BYTES = 64_000_000
#: Bytes of a leaf of the tree, and most bytes that are merged by plain scans.
LEAF, SCANNED = 12, 48
#: A worker remembers pieces in two generations of at most so many, none of more characters than this, and as many pairs of tokens.
MAX_PIECES, MAX_LETTERS = 200_000, 64
#: Texts of more characters are split into pieces one by one, and ids are decoded in stretches of so many.
STRETCH = 1 << 18
NONE = 1 << 60
#: Most rows that are converted at once.
ROWS = 128

# Letters and numbers that Unicode has since version 16, the one that the pattern is read by.
NEWER_LETTERS = (
    "՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ ꭬-꭭"
    " \U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011df1"
    " \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff3 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20"
    " \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24"
    " \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5"
    " \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
NEWER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


NEWER = re.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]")


def compiled(pattern: str) -> regex.Pattern:
    r"""``pattern`` with ``\p{L}`` and ``\p{N}`` as they were in Unicode 16, alone or inside a negated set. Only texts with a newer letter need it."""
    letters, numbers = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_NUMBERS}]]"
    return regex.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers), regex.V1)


class Ranks:
    """Merges bytes by a table of tokens; the token of a lower id is merged first, the leftmost of equals."""

    def __init__(self, table: dict[bytes, int], leaf: int = LEAF):
        if missing := [b for b in range(256) if bytes([b]) not in table]:
            raise ValueError(f"the table of ranks lacks {len(missing)} single bytes")
        self.table, self.leaf = table, leaf
        self.names = [b""] * (max(table.values()) + 1)
        for name, i in table.items():
            self.names[i] = name
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a leaf or a window, from its single bytes."""
        return self._by_scans(piece) if len(piece) <= SCANNED else self._by_heap(piece)

    def _by_scans(self, piece: bytes) -> list[int]:
        get, names, ids = self.table.get, self.names, [self.table[piece[i : i + 1]] for i in range(len(piece))]
        ranks = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while ranks and (low := min(ranks)) < NONE:
            at = ranks.index(low)
            ids[at : at + 2] = [low]  # a rank is the id of what it merges to
            del ranks[at]
            if at:
                ranks[at - 1] = get(names[ids[at - 1]] + names[low], NONE)
            if at < len(ranks):
                ranks[at] = get(names[low] + names[ids[at + 1]], NONE)
        return ids

    def _by_heap(self, piece: bytes) -> list[int]:
        get, n = self.table.get, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a token is piece[i : ends[i]]; an end of 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and ends[i] < n and (r := get(piece[i : ends[ends[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[ends[i]]))

        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j == n or ends[j] != end:
                continue  # one of the two has been merged since
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.table[piece[i : ends[i]]])
            i = ends[i]
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        out = self.known.get((a, b))
        if out is None:
            if len(self.known) >= MAX_PIECES:
                self.known.clear()
            out = self.known[a, b] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        if not left or not right or self.fit(left[-1], right[0]):
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            window = self.merged(b"".join(map(self.names.__getitem__, left[i:] + right[:j])))
            before, after = i == 0 or self.fit(left[i - 1], window[0]), j == len(right) or self.fit(window[-1], right[j])
            if before and after:
                return left[:i] + window + right[j:]
            # Doubling keeps all windows of one seam together at a few times the last one.
            i, j, step = i if before else max(0, i - step), j if after else min(len(right), j + step), 2 * step

    def encode(self, piece: bytes) -> list[int]:
        """The encoding of one match of the pattern: its own token if there is one, else by halves."""
        whole = self.table.get(piece)
        return [whole] if whole is not None else self._halves(piece)

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merged(piece) if piece else []
        half = len(piece) // 2
        return self.joined(self._halves(piece[:half]), self._halves(piece[half:]))


class Codec(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers; pieces are encoded when first asked for."""

    def __init__(self, file: bytes, pattern: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks = Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())})
        self.plain, self.exact = regex.compile(pattern), compiled(pattern)

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.ranks.encode(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) > MAX_LETTERS:
            return out
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        pattern = self.plain if text.isascii() or not NEWER.search(text) else self.exact
        if len(text) <= STRETCH:
            return np.frombuffer(b"".join(map(self.__getitem__, pattern.findall(text))), "<u4")
        out = bytearray()
        for m in pattern.finditer(text):
            out += self[m[0]]
        return np.frombuffer(bytes(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, from halves."""
        if len(ids) <= STRETCH:
            return b"".join(map(self.ranks.names.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: The worker's one codec, by its file's digest and pattern: another takes its place.
_held: dict[tuple[str, str], Codec] = {}


def _codec(file: Broadcast, digest: str, pattern: str) -> Codec:
    if (digest, pattern) not in _held:
        _held.clear()
        _held[digest, pattern] = Codec(file.value, pattern)
    return _held[digest, pattern]


def load(spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN) -> tuple[Broadcast, str, str]:
    """The file of ranks for the executors, which need not have it, its digest and the pattern; the file's size is checked."""
    file = Path(path).read_bytes()
    if len(file) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest(), pattern


def _mapped(df: DataFrame, source: str, add: dict[str, tuple[T.DataType, pa.DataType]], convert) -> DataFrame:
    """``df`` with the columns ``add`` in place of any of these names, from ``convert(array of source) -> arrays``."""
    measured = [source] if isinstance(df.schema[source].dataType, T.StringType) else []
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in add), *(T.StructField(n, kind[0]) for n, kind in add.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, *measured, rows=ROWS):
            kept = [n for n in batch.schema.names if n not in add]
            made = [pa.array(v, kind[1]) for v, kind in zip(convert(batch.column(source)), add.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], names=[*kept, *add])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids``, an array of integers; the strings of special tokens are plain text.

    With ``decoded``, the bytes that ``decode`` gives for these ids come too, in one pass.
    A null text counts as empty and has no ids; texts of any length are encoded whole.
    Equal rows give equal ids; an empty table stays empty; columns with the added names are
    replaced. Nothing moves between tasks.
    """
    held = load(docs.sparkSession, path, pattern)

    def convert(texts: pa.Array) -> list[list]:
        codec = _codec(*held)
        out = [codec.encode(t or "") for t in texts.to_pylist()]
        return [[x.astype("<i4") for x in out], *([[codec.decode(x) for x in out]] if decoded else [])]

    add = {ids: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))} | ({decoded: (T.BinaryType(), pa.binary())} if decoded else {})
    return _mapped(docs, text, add, convert)


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All rows and columns of ``tokens`` with the bytes of ``ids`` (null or empty: empty); a column ``decoded`` is replaced.

    The bytes of ids that were cut between tokens need not be UTF-8, so they stay bytes. An id
    that the table lacks is refused.
    """
    held = load(tokens.sparkSession, path)

    def convert(values: pa.Array) -> list[list]:
        codec = _codec(*held)
        return [[codec.decode(np.array(x or [], np.int64)) for x in values.to_pylist()]]

    return _mapped(tokens, ids, {decoded: (T.BinaryType(), pa.binary())}, convert)
