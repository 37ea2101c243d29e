"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of the pre-tokens come from no regex: each code point is given a class by
table, the class and what follows it make a symbol, and each symbol is a transition
function of a small automaton. The functions that arise by composition are numbered, so
an associative scan over numbers (doubling distances, ended early once every prefix
function is constant) gives the automaton's state at every position of a whole batch.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.bpe_core import SHIFT, merge
from bidweave.llm.common import prepare, sliced, steps

# Classes of code points.
SEP, LETTER, NUMBER, SPACE, WHITE, OTHER = range(6)
#: Code points that are white space beside the blank (fixed values of the Unicode property White_Space).
WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: What Unicode 16, which the library's patterns follow, has beyond the edition that Python knows.
NEWER_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
NEWER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"

# States: between tokens; inside letters, numbers, others, white space; after a blank that
# the next token takes along; two characters or one to go inside a contraction.
FREE, IN_L, IN_N, IN_O, IN_W, PENDING, TWO, ONE = range(8)
# Symbols. A blank or other white space is LAST when a visible character follows.
(S_SEP, S_L, S_N, S_O, S_SPACE_LAST, S_SPACE, S_WHITE_LAST, S_WHITE, S_SHORT, S_LONG) = range(10)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins before this character."""
    if symbol == S_SEP:
        return FREE, True
    if symbol == S_L:
        if state == TWO:
            return ONE, False
        if state == ONE:
            return FREE, False
        return IN_L, state not in (IN_L, PENDING)
    if symbol == S_N:
        return IN_N, state not in (IN_N, PENDING)
    if symbol in (S_O, S_SHORT, S_LONG):
        if state in (IN_O, PENDING):
            return IN_O, False
        return {S_O: IN_O, S_SHORT: ONE, S_LONG: TWO}[symbol], True
    if symbol == S_SPACE_LAST:
        return PENDING, True
    if symbol == S_WHITE_LAST:
        return FREE, True
    return IN_W, state != IN_W


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbered transition functions: of each symbol, their compositions, their value from
    FREE, whether constant, and the table (state, symbol) -> boundary."""
    functions = [tuple(range(8))]
    number = {functions[0]: 0}

    def known(f: tuple[int, ...]) -> int:
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
        return number[f]

    of_symbol = [known(tuple(_step(s, x)[0] for s in range(8))) for x in range(10)]
    table: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(functions):
        done = len(functions)
        for i in range(done):
            for j in range(done):
                if (i, j) not in table:
                    table[i, j] = known(tuple(functions[j][s] for s in functions[i]))
    assert done < 256
    compose = np.zeros((256, 256), np.uint8)
    for (i, j), k in table.items():
        compose[i, j] = k
    from_free = np.array([f[FREE] for f in functions], np.uint8)
    constant = np.array([len(set(f)) == 1 for f in functions])
    boundary = np.array([[_step(s, x)[1] for x in range(10)] for s in range(8)])
    return np.array(of_symbol, np.uint8), compose.ravel(), from_free, constant, boundary.ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1))
    major = np.frombuffer(kinds.encode("ascii"), np.uint8)
    out[major == ord("L")] = LETTER
    out[major == ord("N")] = NUMBER
    for ranges, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for found in ranges.split():
            first, _, last = found.partition("-")
            out[int(first, 16) : int(last or first, 16) + 1] = kind
    out[WHITE_SPACE] = WHITE
    out[ord(" ")] = SPACE
    return out


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets of all pre-tokens in the texts put one after another, and of the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(lengths.sum()) + len(texts)
    # A separator follows each text; code point 0 in a text is OTHER, so its place is marked afterwards.
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths + 1) - 1
    kind = classes()[points]
    kind[ends] = SEP
    nxt = np.empty(n, np.uint8)
    nxt[:-1], nxt[-1] = kind[1:], SEP
    visible = (nxt == LETTER) | (nxt == NUMBER) | (nxt == OTHER)
    symbol = np.array([S_SEP, S_L, S_N, S_SPACE, S_WHITE, S_O], np.uint8)[kind]
    symbol[(kind == SPACE) & visible] = S_SPACE_LAST
    symbol[(kind == WHITE) & visible] = S_WHITE_LAST
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[quotes < n - 1]
    if len(quotes):
        first, second = points[quotes + 1], points[np.minimum(quotes + 2, n - 1)]
        symbol[quotes[np.isin(first, [ord(c) for c in "stmd"])]] = S_SHORT
        pair = first.astype(np.int64) << 21 | second
        symbol[quotes[np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = S_LONG
    of_symbol, compose, from_free, constant, boundary = automaton()
    prefix = of_symbol[symbol]
    distance = 1
    # An entry covers the last ``distance`` symbols up to its place, so those before it are whole,
    # and of the others those that are constant no longer depend on what lies further back.
    while distance < n and not constant[prefix[distance:]].all():
        joined = prefix.copy()
        joined[distance:] = compose[(prefix[:-distance].astype(np.uint16) << 8) | prefix[distance:]]
        prefix, distance = joined, distance * 2
    state = np.empty(n, np.uint8)
    state[0], state[1:] = FREE, from_free[prefix[:-1]]
    starts = np.flatnonzero(boundary[state.astype(np.uint8) * 10 + symbol])
    return starts, ends


class ByteBpe:
    """One vocabulary of byte sequences with ranks; a rank is the token's id."""

    #: Pre-tokens whose ids are kept; beyond that the store is emptied, which costs time only.
    KEPT = 300_000

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.ranks = ranks
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs = {ranks[t[:i]] << SHIFT | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        top = max(ranks.values()) + 1
        self.bytes_of = [b""] * top
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.kept: dict[str, bytes] = {}

    def ids(self, piece: str) -> bytes:
        """Ids of one pre-token, little-endian 32-bit."""
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        found = [whole] if whole is not None else merge([self.single[b] for b in raw], self.pairs.get)
        return np.array(found, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text its ids as little-endian 32-bit bytes, and the pre-tokens' start offsets in it."""
        starts, ends = boundaries(texts)
        whole = "\0".join([*texts, ""])
        kept = self.kept
        if len(kept) > self.KEPT:
            kept.clear()
        edges = starts.tolist()
        at = np.searchsorted(starts, ends).tolist()  # each separator begins a "token" of its own
        first, base = 0, 0
        for last, end in zip(at, ends.tolist()):
            cut = edges[first : last + 1]
            pieces = [whole[a:b] for a, b in zip(cut, cut[1:])]
            try:
                out = b"".join([kept[p] for p in pieces])
            except KeyError:
                for p in pieces:
                    if p not in kept:
                        kept[p] = self.ids(p)
                out = b"".join([kept[p] for p in pieces])
            yield out, starts[first:last] - base
            first, base = last + 1, end + 1

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _with_ids(path: str | None, keep_ids: bool, keep_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_ranks())
        for batch in sliced(batches):
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            counts, digests, decoded, ids, offsets = [], [], [], [], []
            for a, b in steps(texts):
                for text, (raw, starts) in zip(texts[a:b], bpe.encode(texts[a:b])):
                    back = bpe.decode(raw)
                    counts.append(len(raw) // 4)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(raw, "<i4"))
                    if keep_offsets:
                        offsets.append(starts.astype(np.int32))
            columns = [keys, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["_key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_offsets:
                columns.append(pa.array(offsets, pa.list_(pa.int32())))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, keep_ids: bool = False, keep_offsets: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the id column, n_tokens, ids_sha256 and decoded_sha256; with ``keep_ids`` also
    ``ids``, with ``keep_offsets`` also ``offsets`` (start of each pre-token, in code points).
    Null counts as the empty text, which has no tokens. Repeated rows each give a row, an
    empty table gives none, other columns are left out, and long texts are taken whole.
    ``ranks_path`` is a path on the executors; by default the installed public vocabulary.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", offsets array<int>" * keep_offsets
    taken = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    return taken.mapInArrow(_with_ids(ranks_path, keep_ids, keep_offsets), schema).withColumnRenamed("_key", id_col)


def decode_ids(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Adds the UTF-8 text of an array of ids; null ids give null, an empty array gives the empty text."""
    prepare(df.sparkSession)

    def run(series):
        import pandas as pd

        bpe = encoder(ranks_path or default_ranks())
        return pd.Series([None if x is None else b"".join([bpe.bytes_of[i] for i in x]).decode("utf-8", "replace") for x in series])

    return df.withColumn(out_col, F.pandas_udf(run, "string")(F.col(ids_col)))
