"""Token ids of a whole corpus by a public byte-level BPE vocabulary, long unsplit text by tree concatenation.

Texts up to LONG characters are encoded where they lie, without a shuffle. A longer text is cut after a visible
character that a blank follows (the splitting pattern never matches across such a place), and its pieces are encoded
in parallel. A stretch that the pattern itself doesn't split (a run of letters, digits, signs or white space of more
than LEAF bytes) is halved again and again down to LEAF bytes; the leaves are encoded in parallel and joined pairwise
in a tree: at each join a window of tokens from both sides is encoded again, four times as large each round, until it
begins with tokens of the left side and ends with tokens of the right side. A BPE sequence whose neighbouring tokens
all stand side by side in encodings of some text is itself the encoding of its bytes, so the joined ids are exact.

Defined results: null and empty text give an empty list; every row gives one row, repeated rows too; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.tables import read

TOKENIZERS = os.environ.get("CHARTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
LONG, LEAF, AGREE = 1 << 16, 1 << 14, 4
#: The same for texts of letters only, which take the tree from this length on.
UNSPLIT = 512
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = regex.compile(r"[\p{L}\p{N}.,;:!?)](?=[ \n])")
_SPLIT = regex.compile(PATTERN)
_UNSURE = regex.compile(r"[\x1c-\x1f\x85\p{Cn}]")  # where libraries may class characters differently
_LOADED: dict = {}


def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The vocabulary, loaded once a Python worker."""
    if (folder, name) not in _LOADED:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for inner in ("encode_to_tiktoken_buffer", "encode_single_piece"):
            if not hasattr(enc._core_bpe, inner):
                raise RuntimeError(f"this version of tiktoken ({getattr(tiktoken, '__version__', '?')}) has no {inner}, on which this module rests")
        _LOADED[folder, name] = enc
    return _LOADED[folder, name]


def encode_text(enc, text: str) -> np.ndarray:
    return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32)


def pieces(text: str, long: int = LONG, leaf: int = LEAF) -> Iterator[tuple[int, bool, bytes]]:
    """(unit, raw, bytes) in order: parts that can be encoded on their own; the leaves of one unit are to be joined."""
    unit, start, size = 0, 0, len(text)
    while start < size:
        end = size
        if size - start > long:
            m = _SAFE.search(text, start + long - 1)
            end = m.end() if m else size
        part = text[start:end]
        if len(part) <= 2 * long or _UNSURE.search(part):
            yield unit, False, part.encode()
            unit += 1
        else:
            for raw, body in _unsplit(part, long, leaf):
                leaves = 1
                while raw and len(body) / leaves > leaf:
                    leaves *= 2
                for k in range(leaves):
                    yield unit, raw, body[k * len(body) // leaves : (k + 1) * len(body) // leaves]
                unit += 1
        start = end


def _unsplit(part: str, long: int, leaf: int) -> Iterator[tuple[bool, bytes]]:
    """A part without safe places as (raw, bytes): runs of the pattern's matches, and each large match by itself (raw).

    A run ends after a visible character, as blanks at its end could join with what follows; blanks before a large
    match are given raw.
    """
    held: list[str] = []
    size = 0
    for m in _SPLIT.finditer(part):
        t = m[0]
        if len(t) > leaf // 4:
            blanks = []
            while held and held[-1][-1].isspace():
                blanks.append(held.pop())
            if held:
                yield False, "".join(held).encode()
            for x in [*reversed(blanks), t]:
                yield True, x.encode()
            held, size = [], 0
            continue
        held.append(t)
        size += len(t)
        if size >= long and not t[-1].isspace():
            yield False, "".join(held).encode()
            held, size = [], 0
    if held:
        yield False, "".join(held).encode()


def join_ids(enc, left: list[int], right: list[int], window: int = 8) -> list[int]:
    """The ids of the two sides' bytes together."""
    if not left or not right:
        return left or right
    k = window
    while True:
        a, b = left[-k:], right[:k]
        w = enc._core_bpe.encode_single_piece(enc.decode_bytes(a + b))
        n = min(AGREE, k // 2)
        if (k >= len(left) or w[:n] == a[:n]) and (k >= len(right) or w[-n:] == b[-n:]):
            return left[: max(0, len(left) - k)] + w + right[k:]
        k *= 4


def join_tree(enc, leaves: list[list[int]]) -> list[int]:
    while len(leaves) > 1:
        leaves = [join_ids(enc, leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.int32, copy=False) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(docs: DataFrame, folder: str = TOKENIZERS, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids of every row of a table with doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def short_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, none = encoding(folder), np.empty(0, np.uint32)
        for b in batches:
            ids = [encode_text(enc, t) if t else none for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], ["doc_id", "ids"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for b in batches:
            for h, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(h, doc, n, u, raw, body) for n, (u, raw, body) in enumerate(pieces(text, long, leaf))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["h", "doc_id", "part", "unit", "raw", "body"])

    def leaf_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in batches:
            ids = [np.array(enc._core_bpe.encode_single_piece(x), np.uint32) if raw else encode_text(enc, x.decode()) for raw, x in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(ids)], ["h", "doc_id", "part", "unit", "ids"])

    def join_rows(table: pa.Table) -> pa.Table:
        # Rows that are repeated as a whole bring each of their parts as often: one is joined, and given as often.
        enc, units, copies = encoding(folder), {}, 0
        rows = sorted(zip(table["part"].to_pylist(), table["unit"].to_pylist(), table["ids"].to_pylist()))
        for k, (part, unit, ids) in enumerate(rows):
            copies += part == rows[0][0]
            if k == 0 or rows[k - 1][0] != part:
                units.setdefault(unit, []).append(ids)
        out = np.concatenate([np.array(join_tree(enc, x), np.uint32) for x in units.values()])
        return pa.table([pa.array([table["doc_id"][0].as_py()] * copies, pa.int64()), _lists([out] * copies)], ["doc_id", "ids"])

    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = docs.where(~is_long).mapInArrow(short_rows, "doc_id bigint, ids array<int>")
    # The key of a text's parts is of its content, so a task that is run again gives the same keys.
    parts = docs.where(is_long).select(F.xxhash64("text").alias("h"), F.coalesce("doc_id", F.lit(None).cast("bigint")).alias("doc_id"), "text").mapInArrow(cut, "h bigint, doc_id bigint, part bigint, unit bigint, raw boolean, body binary")
    leaves = parts.repartition("h", "part").mapInArrow(leaf_rows, "h bigint, doc_id bigint, part bigint, unit bigint, ids array<int>")
    return short.unionByName(leaves.groupBy("h", "doc_id").applyInArrow(join_rows, "doc_id bigint, ids array<int>"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read(spark, sf_dir, "documents"))


def p7_unsplit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's letters alone, run together: texts that no pattern splits, through the tree of halves."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\p{L}]+", "").alias("text"))
    return encode_corpus(docs, long=UNSPLIT, leaf=UNSPLIT // 4)


QUERIES = {"p7_ids": p7_ids, "p7_unsplit_ids": p7_unsplit_ids}
ORACLE: dict[str, str] = {}
