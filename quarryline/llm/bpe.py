"""BPE encoding and decoding with a public tokenizer's merges.

A word is merged over a segment tree of its adjacent pairs' ranks: the root is the
leftmost pair of the lowest rank, and a merge changes at most three leaves, each in
logarithmic time, so a word of any length takes O(n log n). The trees of many words lie
side by side as rows of an array and take a merge each at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import batched
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarryline.llm.batches import pieces
from quarryline.llm.byte_bpe import NEWER_LETTERS, NEWER_NUMBERS, compiled

#: Largest tokenizer file that is broadcast.
MAX_FILE_BYTES = 64_000_000
#: A worker remembers words in two generations of at most so many (or one piece's new words), none of more characters than this: about 40 MB.
MAX_WORDS, MAX_LETTERS = 100_000, 64
#: Texts of more characters are split into words one by one, and ids are decoded in stretches of so many.
STRETCH = 1 << 18
#: Words whose trees are merged at once: fewer go one by one, more in parts.
FEWEST, ABREAST = 24, 8192
NONE = 1 << 60
#: A leaf without a pair, in arrays.
EMPTY = np.iinfo(np.int64).max
# Capitals that the library lowers and the interpreter's older tables lack (Unicode 16 and 17).
LOWERED = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
#: Texts with one of these are lowered and split with care.
UNEVEN = re.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}{''.join(map(chr, LOWERED))}]")
#: All of these come from here on; one range is looked for much faster than many.
LATER = re.compile("[\u0558-\U0010ffff]")


def merge_word(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges; ``ranks`` maps a pair of ids to (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    if n == 2:
        hit = ranks.get((ids[0], ids[1]))
        return ids if hit is None else [hit[1]]
    size = 1 << (n - 2).bit_length()
    # A leaf holds rank * 2**32 + position, so that the smaller of two nodes is also the one further left.
    tree = [NONE << 32] * (2 * size)
    for i in range(n - 1):
        hit = ranks.get((ids[i], ids[i + 1]))
        if hit is not None:
            tree[size + i] = hit[0] << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < NONE << 32:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        ids[i] = ranks[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE << 32)
        if k < n:
            before[k] = i
            hit = ranks.get((ids[i], ids[k]))
            put(i, NONE << 32 if hit is None else hit[0] << 32 | i)
        else:
            put(i, NONE << 32)
        h = before[i]
        if h >= 0:
            hit = ranks.get((ids[h], ids[i]))
            put(h, NONE << 32 if hit is None else hit[0] << 32 | h)
    return [x for x in ids if x >= 0]


class Pairs:
    """The ranks of pairs of ids, for arrays of pairs."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        a, b, rank, made = np.array([(*pair, *to) for pair, to in ranks.items()], np.int64).reshape(-1, 4).T
        order = np.argsort(a << 32 | b)
        # The last key is no pair's: what is looked up beyond all others meets it.
        self.keys, self.ranks = np.append((a << 32 | b)[order], EMPTY), np.append(rank[order], 0)
        self.made = np.zeros(int(rank.max(initial=-1)) + 1, np.int64)
        self.made[rank] = made

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * 2**32 + at of the pairs (a, b), ``EMPTY`` where they don't merge; an id of -1 merges with none."""
        key = a << 32 | b
        place = np.searchsorted(self.keys, key)
        return np.where((self.keys[place] == key) & (a >= 0) & (b >= 0), self.ranks[place] << 32 | at, EMPTY)


def merge_words(ids: np.ndarray, pairs: Pairs) -> np.ndarray:
    """``merge_word`` of each row, whose symbols end with an id of -1 at least; merged symbols are -1 in the result.

    Row by row the same tree: node k has the children 2k and 2k + 1, the root is node 1, and
    leaf i is the pair of the symbol at i and the next that is left.
    """
    n, width = ids.shape
    size = width - 1
    assert size & (size - 1) == 0, "a power of two, and one more"
    out, rows = ids.reshape(-1).copy(), np.arange(n)
    tree = np.full((n, 2 * size), EMPTY)
    places = np.arange(size)
    tree[:, size:] = pairs.leaves(ids[:, :-1], ids[:, 1:], places)
    low = size
    while low > 1:
        tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
        low //= 2
    tree = tree.reshape(-1)
    after, before = np.tile(np.arange(1, width + 1), n), np.tile(np.arange(-1, size), n)
    while True:
        root = tree[rows * (2 * size) + 1]
        open_ = root < EMPTY
        rows, root = rows[open_], root[open_]
        if not len(rows):
            return out.reshape(n, width)
        at, leaf = rows * width, rows * (2 * size) + size
        i = root & 0xFFFFFFFF
        j = after[at + i]
        k = after[at + j]
        new = pairs.made[root >> 32]
        out[at + i], out[at + j] = new, -1
        after[at + i], before[at + k] = k, i
        h = before[at + i]
        first = h < 0
        # Nothing before: the leaf of the symbol that went is emptied a second time.
        h[first] = j[first]
        tree[leaf + j] = EMPTY
        tree[leaf + i] = pairs.leaves(new, out[at + k], i)
        tree[leaf + h] = pairs.leaves(out[at + h], new, h)
        base, node = np.tile(rows * (2 * size), 3), np.concatenate((i, j, h)) + size
        for _ in range(size.bit_length() - 1):
            node >>= 1
            below = base + 2 * node
            tree[base + node] = np.minimum(tree[below], tree[below + 1])


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers; words are encoded when first asked for."""

    def __init__(self, file: bytes):
        super().__init__()
        self.older: dict[str, bytes] = {}
        spec = json.loads(file)
        check(spec)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        self.last = [vocab.get(letters[b] + suffix, -1) for b in range(256)]
        self.firsts, self.lasts = np.array(self.first), np.array(self.last)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pairs = Pairs(self.ranks)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special = {t: i.to_bytes(4, "little") for t, i in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.plain, self.exact = regex.compile(pattern), compiled(pattern)

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            raw = word.encode()
            out = np.array(merge_word([*(self.first[b] for b in raw[:-1]), self.last[raw[-1]]], self.ranks), "<u4").tobytes()
        if len(word) > MAX_LETTERS:
            return out
        if len(self) >= MAX_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def learn(self, words: set[str]) -> None:
        """Remembers those of ``words`` that aren't yet, encoded together by the lengths of their trees."""
        fresh = [w for w in words if w not in self and w not in self.older and len(w) <= MAX_LETTERS]
        if len(self) + len(fresh) > MAX_WORDS:
            self.older = dict(self)
            self.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in fresh:
            raw = word.encode()
            by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((word, raw))
        for size, some in by_size.items():
            # The fewer, the more each step costs a word; the rest is encoded when it is asked for.
            for start in range(0, len(some) if len(some) >= FEWEST else 0, ABREAST):
                part = some[start : start + ABREAST]
                length = np.array([len(raw) for _, raw in part])
                ids = np.full((len(part), size + 1), -1)
                ids[np.arange(size + 1) < length[:, None]] = self.firsts[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                ids[np.arange(len(part)), length - 1] = self.lasts[[raw[-1] for _, raw in part]]
                ids = merge_words(ids, self.pairs)
                kept = ids >= 0
                data, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
                self.update(zip((word for word, _ in part), map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _plain(self, text: str) -> tuple[str, regex.Pattern]:
        """The normalized text, and the pattern that its words are found by."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Each character alone: a final sigma is lowered like any other.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        pattern = self.plain
        if not text.isascii() and LATER.search(text) and UNEVEN.search(text):
            text, pattern = text.translate(LOWERED), self.exact
        return text, pattern

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new words of all of them are learned together."""
        found = []
        for text in texts:
            parts = self.split.split(text) if any(t in text for t in self.special) else [text]
            found.append([self.special[part] if k % 2 else self._words(*self._plain(part)) for k, part in enumerate(parts)])
        self.learn(set().union(*(words for parts in found for words in parts if isinstance(words, list))))
        return [b"".join(words if isinstance(words, bytes) else b"".join(map(self.__getitem__, words)) for words in parts) for parts in found]

    def _words(self, text: str, pattern: regex.Pattern) -> list[str] | bytes:
        """The words of a text or, for the list of all words would be many times a long text, their ids."""
        if len(text) <= STRETCH:
            return pattern.findall(text)
        out = bytearray()
        for words in batched((m[0] for m in pattern.finditer(text)), ABREAST):
            self.learn(set(words))
            out += b"".join(map(self.__getitem__, words))
        return bytes(out)

    def decode(self, ids: bytes) -> str:
        """The ids' vocabulary strings, special ones included, joined by spaces."""
        numbers = np.frombuffer(ids, "<u4")
        return " ".join(" ".join(map(self.names.__getitem__, numbers[at : at + STRETCH].tolist())) for at in range(0, len(numbers), STRETCH))


def check(spec: dict) -> None:
    """Refuses a tokenizer's file whose steps aren't the ones that are carried out here."""

    def kinds(part: dict | None, inner: str) -> list[str]:
        return [] if part is None else [x["type"] for x in part.get(inner, [part])]

    normal, before = spec.get("normalizer"), spec.get("pre_tokenizer")
    steps = before.get("pretokenizers", []) if before else []
    model = spec["model"]
    spaces = [x for x in (normal or {}).get("normalizers", []) if x["type"] == "Replace"]
    wrong = [
        ("model", model.get("type", "BPE") != "BPE" or bool(model.get("dropout")) or bool(model.get("continuing_subword_prefix")) or bool(model.get("ignore_merges")) or bool(model.get("byte_fallback"))),
        ("normalizer", [k for k in kinds(normal, "normalizers") if k != "Replace"] != ["NFC", "Lowercase"] or any(x["pattern"] != {"Regex": "\\s+"} or x["content"] != " " for x in spaces)),
        ("pre_tokenizer", [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["add_prefix_space"]),
        ("decoder", kinds(spec.get("decoder"), "decoders") != []),
        ("added_tokens", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])),
    ]
    if bad := [name for name, is_bad in wrong if is_bad]:
        raise ValueError("this tokenizer's file isn't supported: " + ", ".join(bad))


#: The worker's one tokenizer, by its file's digest: another file takes its place.
_held: dict[str, Codec] = {}


def _codec(file: Broadcast, digest: str) -> Codec:
    if digest not in _held:
        _held.clear()
        _held[digest] = Codec(file.value)
    return _held[digest]


def load(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """The tokenizer's file for the executors, which need not have it, and its digest; its size and steps are checked."""
    file = Path(path).read_bytes()
    if len(file) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    check(json.loads(file))
    return spark.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()


def _mapped(df: DataFrame, source: str, add: list[tuple[str, T.DataType, pa.DataType]], convert) -> DataFrame:
    """``df`` with columns of ``add`` in place of any of these names, from ``convert(values of source) -> lists``."""
    names = [a[0] for a in add]
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(n, t) for n, t, _ in add)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, source):
            kept = [n for n in batch.schema.names if n not in names]
            made = [pa.array(v, kind) for v, (_, _, kind) in zip(convert(batch.column(source).to_pylist()), add, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], names=[*kept, *names])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids``: binary, little-endian unsigned 32-bit integers.

    With ``decoded``, the text that ``decode`` gives for these ids comes too, in one
    pass. A null text counts as empty and has no ids; texts of any length are encoded
    whole; special tokens' strings in a text become their ids. Equal rows give equal
    ids; an empty table stays empty; columns with the added names are replaced. A
    tokenizer's file with other steps than ``check`` allows is refused.
    """
    held = load(docs.sparkSession, path)

    def convert(texts: list[str | None]) -> list[list]:
        codec = _codec(*held)
        out = codec.encode_all([t or "" for t in texts])
        return [out, *([[codec.decode(x) for x in out]] if decoded else [])]

    return _mapped(docs, text, [(ids, T.BinaryType(), pa.binary()), *([(decoded, T.StringType(), pa.string())] if decoded else [])], convert)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns of ``tokens`` with ``text``, decoded from ``ids`` (null or empty: empty); a column ``text`` is replaced."""
    held = load(tokens.sparkSession, path)
    return _mapped(tokens, ids, [(text, T.StringType(), pa.string())], lambda values: [[_codec(*held).decode(x or b"") for x in values]])
