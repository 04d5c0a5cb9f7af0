"""Byte-level BPE: encoding to ids with character offsets, and decoding back to bytes.

The vocabulary is a rank file (base64 token, rank). Its merges are rebuilt from the ranks for
the tokenizers library: every split of a token into two tokens is a merge, in order of the
token's rank. A text is cut by the pattern; each distinct piece is encoded once per cache life
and its ids are reused. Pieces in which two overlapping splits tie are merged by rank directly,
since the library would order such ties by merge instead of by place.
"""

from __future__ import annotations

import base64
import heapq
import os
import struct
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, PIECE, arrow_stage, documents, narrow

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: White space as the rank files' library has it: Unicode's White_Space, without U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: White space before a space: the pattern may not cut there.
DOUBLE = regex.compile(f"[{SPACE}] ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def byte_table() -> list[str]:
    """A visible character for each byte: printable Latin-1 stays, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def splits(ranks: dict[bytes, int]) -> dict[bytes, list[tuple[bytes, bytes]]]:
    return {
        token: [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        for token in ranks
        if len(token) > 1
    }


def ties(parts: dict[bytes, list[tuple[bytes, bytes]]]) -> list[bytes]:
    """Strings in which two different splits of one token overlap."""
    found = set()
    for pairs in parts.values():
        if len(pairs) > 1:
            found |= {x + y + z for x, y in pairs for y2, z in pairs if y == y2 and (x, y) != (y, z)}
    return sorted(found)


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = ends[at]
        if middle < n:
            rank = ranks.get(piece[at : ends[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[middle]))

    for at in range(n - 1):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not alive[at] or middle >= n or ends[middle] != end:
            continue
        alive[middle], ends[at] = False, end
        if end < n:
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [ranks[piece[at : ends[at]]] for at in range(n) if alive[at]]


class Encoder:
    """Encodes texts piece by piece; holds a bounded cache of encoded pieces."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        from tokenizers import models

        self.ranks = load_ranks(path)
        table = byte_table()
        self.table = {b: c for b, c in enumerate(table)}
        seen = {token: "".join(map(table.__getitem__, token)) for token in self.ranks}
        parts = splits(self.ranks)
        merges = [(seen[a], seen[b]) for token in sorted(parts, key=self.ranks.__getitem__) for a, b in parts[token]]
        self.model = models.BPE({seen[t]: r for t, r in self.ranks.items()}, merges, ignore_merges=True)
        self.tied = ahocorasick.Automaton()
        for tie in [*ties(parts), b"\0" * 300]:  # an automaton needs a word
            self.tied.add_word("".join(map(table.__getitem__, tie)), True)
        self.tied.make_automaton()
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.single = {token.decode(): struct.pack("<I", rank) for token, rank in self.ranks.items() if _is_text(token)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (packed := self.single.get(piece)) is not None:
            return packed
        raw = piece.encode()
        mapped = raw.decode("latin-1").translate(self.table)
        if next(self.tied.iter(mapped), None) is None:
            ids = [token.id for token in self.model.tokenize(mapped)]
        else:
            ids = merge_by_rank(raw, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> None:
        """Encode a space and the word, for words that the cache lacks. What it held last stays
        at hand for one more life."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, find, piece = self.known, self.older, self.pattern.findall, self._piece
        for word in set(words).difference(known):
            known[word] = older.get(word) or b"".join(map(piece, find(" " + word)))

    def pieces(self, text: str):
        if len(text) <= PIECE:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(found, CACHE)):
                yield part

    def __call__(self, text: str | None) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) > PIECE or DOUBLE.search(text):
            return b"".join(self._piece(p) for pieces in self.pieces(text) for p in pieces)
        first, *words = text.split(" ")  # the pattern cuts before a space that follows no space
        try:
            rest = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            rest = b"".join(map(self.known.__getitem__, words))
        return b"".join(map(self._piece, self.pattern.findall(first))) + rest


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def offsets(ids: np.ndarray, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token; a token that holds part of a
    character counts the whole of it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return char[ends - lengths[ids]].astype("<u4"), (char[ends - 1] + 1).astype("<u4")


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_offsets: bool = False) -> DataFrame:
    """One row per row of df: key, n_tokens (long), ids (binary: little-endian unsigned 32-bit
    integers), and on request starts and ends (character offsets, packed likewise).

    A null text counts as empty and gives no ids. Other columns of df are left out. The
    vocabulary file must be readable at `path` on every executor.
    """
    kind = df.schema[key].dataType.simpleString()
    extra = ", starts binary, ends binary" if with_offsets else ""

    def make() -> Callable:
        encoder = Encoder(path, pattern)
        lengths = np.zeros(max(encoder.ranks.values(), default=-1) + 1, np.int64)
        for token, rank in encoder.ranks.items():
            lengths[rank] = len(token)

        def each(batch: pa.RecordBatch):
            texts = _column(batch, text)
            ids = [encoder(t) for t in texts]
            columns = {key: batch.column(batch.schema.get_field_index(key)), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if with_offsets:
                both = [offsets(np.frombuffer(x, "<u4"), lengths, t or "") for x, t in zip(ids, texts, strict=True)]
                columns |= {"starts": pa.array([b[0].tobytes() for b in both], pa.binary()), "ends": pa.array([b[1].tobytes() for b in both], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        return each

    return arrow_stage(narrow(df, key, text), make, f"`{key}` {kind}, n_tokens long, ids binary{extra}")


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "n_tokens"), ids: str = "ids") -> DataFrame:
    """The columns kept, ids, and decoded (binary): the bytes of the ids in order.

    Bytes are joined before anything reads them as characters, so a character whose bytes are
    split between tokens comes back whole. decoded_text gives them as a string. A null in ids
    counts as no ids; an id outside the vocabulary is an error.
    """
    kept = [*keep, ids]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", decoded binary"

    def make() -> Callable:
        tokens = {rank: token for token, rank in load_ranks(path).items()}

        def each(batch: pa.RecordBatch):
            data = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in _column(batch, ids)]
            return pa.RecordBatch.from_pydict({c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {"decoded": pa.array(data, pa.binary())})

        return each

    return arrow_stage(narrow(df, *kept), make, schema)


def decoded_text(column: str = "decoded"):
    """The decoded bytes as text; bytes that are no UTF-8, as of a cut list of ids, become U+FFFD."""
    return F.decode(F.col(column), "UTF-8")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    back = decode(encode(documents(spark, sf_dir), path, pattern), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
