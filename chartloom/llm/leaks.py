"""Passages of evaluation items in a corpus, by a distributed positional inverted index.

1. Index: each document's postings, written once to the shared folder: one row a document with the 32-bit hashes of its
   neighbouring word pairs in order, so a posting's place is its position. It holds all pairs of all documents and does
   not depend on the items, so that one index serves any number of item sets (`build_index`, `leaks(..., index=...)`).
2. Rarest terms: the corpus frequency of every pair that a passage holds; of each stretch of STRETCH words of a passage
   the RAREST pairs that occur in the corpus become its probes; a passage of up to SHORT words takes all of its pairs.
3. Intersection, inside each document's row: a posting meets a probe at the offset pos - i; probes of one item that agree
   on the offset within DRIFT words (words may be put in or left out) are a phrase or proximity match. A document that
   holds at least a PART-th of an item's probes in such matches (2 at least and PROBES at most, and never more than the
   item has) is a candidate, with the places where they lie. Nothing but candidates leaves the row: no shuffle.
4. Exact check: the words around each of these places are aligned with the passage by local alignment (match 1, else
   -1); alignments of at least LEAST points (three quarters of a shorter passage) count. A document leaks an item if SHARE of the passage's words are
   aligned; the match is exact if the whole passage stands there word by word, else by proximity.

Statistics and candidates cover all documents. Items of more than BROADCAST_PAIRS pairs are asked in blocks of so many
against the same index. Defined results: null, empty and blank texts or passages, and passages of one word, give nothing;
equal words in another case, with other marks or line ends are the same; copies of a document are cases of their own;
repeated rows of a document or item give one row; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.session import written
from chartloom.sources.tables import read

STRETCH, RAREST, SHORT, DRIFT, PROBES, PART, LEAST, SHARE = 6, 2, 30, 8, 6, 4, 8, 0.43
#: Word pairs of passages that are asked at once: they are sent to every worker, 12 bytes a probe.
BROADCAST_PAIRS = 500_000
MARGIN = 40
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_POWERS: list[np.ndarray] = []
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Characters that are hashed at once (some 60 bytes each while it lasts); a longer text is cut between words.
AT_ONCE = 1 << 20


def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which characters belong to words, and the powers of the base and of its inverse modulo 2^64."""
    if not _POWERS:
        _POWERS[:] = [np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000), np.ones(1, np.uint64), np.ones(1, np.uint64)]
    if len(_POWERS[1]) < size:
        for k, base in ((1, _BASE), (2, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1], _POWERS[2]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(begins, hashes) of the words of a lower-case text, all at once: differences of prefix sums of a polynomial in the characters."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, power, inverse = _tables(len(a) + 1)
    edge = np.diff(letters[a].view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a.astype(np.uint64) * power[: len(a)], out=total[1:])
    h = (total[end] - total[begin]) * inverse[begin]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    return begin, h ^ (h >> np.uint64(32))


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        end = min(len(text), start + AT_ONCE)
        while end < len(text) and text[end].isalnum():
            end += 1
        yield text[start:end]
        start = end


def pair_terms(texts: list[str]) -> list[np.ndarray]:
    """The 32-bit hashes of the neighbouring word pairs of each text, in order."""
    out: list[np.ndarray] = []
    held: list[str] = []
    size = 0

    def pairs(h: np.ndarray) -> np.ndarray:
        return ((h[:-1] * np.uint64(_BASE) + h[1:]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def flush() -> None:
        nonlocal held, size
        if held:
            begin, h = word_hashes("\n".join(held))
            cuts = np.cumsum([len(t) + 1 for t in held])[:-1]
            out.extend(pairs(x) for x in np.split(h, np.searchsorted(begin, cuts)))
        held, size = [], 0

    for t in texts:
        t = t.lower()
        if len(t) > AT_ONCE:
            flush()
            out.append(pairs(np.concatenate([word_hashes(x)[1] for x in _pieces(t)])))
            continue
        if size + len(t) > AT_ONCE:
            flush()
        held.append(t)
        size += len(t) + 1
    flush()
    return out


def indexed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms) of the rows with a text."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = pair_terms(b.column(1).to_pylist())
            offsets = np.zeros(len(terms) + 1, np.int32)
            np.cumsum([len(x) for x in terms], out=offsets[1:])
            flat = np.concatenate(terms) if terms else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "terms"])

    return rows.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).where("trim(text) <> ''").mapInArrow(cut, f"{key} bigint, terms array<int>")


def build_index(corpus: DataFrame) -> DataFrame:
    """The stored index (doc_id, terms) of every document."""
    return written(indexed(corpus, "doc_id", "text").where("size(terms) > 0"))


def item_pairs(items: DataFrame) -> DataFrame:
    """(item_id, size, i, term) of every pair of every passage; size counts its pairs."""
    p = indexed(items, "item_id", "passage")
    return p.select("item_id", F.size("terms").alias("size"), F.posexplode("terms").alias("i", "term"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, place and term of every posting of a batch (doc_id, terms)."""
    col = batch.column(1)
    offsets = col.offsets.to_numpy()
    terms = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(terms)) - np.repeat(offsets[:-1] - offsets[0], size), terms


def frequencies(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, df): how often each wanted term (sorted, distinct) stands in the corpus."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            terms = _flat(b)[2]
            at = np.searchsorted(wanted, terms)
            at[at == len(wanted)] = 0
            total += np.bincount(at[wanted[at] == terms], minlength=len(wanted))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[held]), pa.array(total[held])], ["term", "df"])

    return index.select("doc_id", "terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def rarest_probes(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """(item_id, i, term): the rarest pairs of each stretch of a passage that occur in the corpus; all pairs of a short one."""
    w = Window.partitionBy("item_id", F.floor(F.col("i") / STRETCH)).orderBy("df", "i")
    held = pairs.join(df, "term").withColumn("n", F.row_number().over(w))
    return held.where((F.col("n") <= RAREST) | (F.col("size") < SHORT)).select("item_id", "i", "term")


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the runs of equal rows in a sorted key matrix, and the run of each row."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def candidates(index: DataFrame, probes: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, item_id, spans): documents with enough probes (item_id, i, term) in agreement, and the places where they lie."""
    probes = sorted(probes, key=lambda p: p[2])
    term, at_i = np.array([p[2] for p in probes], np.int32), np.array([p[1] for p in probes], np.int64)
    ids, item = np.unique(np.array([p[0] for p in probes], np.int64), return_inverse=True)
    own = np.bincount(item, minlength=len(ids))
    floor = np.minimum(own, np.minimum(PROBES, np.maximum(2, own // PART)))
    schema = "doc_id bigint, item_id bigint, spans array<struct<lo:int,hi:int>>"
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, terms = _flat(b)
            left, right = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
            n = right - left
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            rep = np.repeat(hit, n[hit])
            probe = np.arange(len(rep)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + np.repeat(left[hit], n[hit])
            offset = pos[rep] - at_i[probe]
            # A hit lies in one even and one odd cell of offsets; the better kind counts.
            r, it, i, p = (np.concatenate([x, x]) for x in (row[rep], item[probe], at_i[probe], pos[rep]))
            cell = np.concatenate([offset // DRIFT * 2, (offset + DRIFT // 2) // DRIFT * 2 + 1])
            order = np.lexsort((p, i, cell, it, r))
            key = np.stack([r, it, cell, i], 1)[order]
            p = p[order]
            first, run = _grouped(key)
            lo, hi = p[first], np.maximum.reduceat(p, first)
            key = key[first]
            first, run = _grouped(key[:, :3])
            count, lo, hi, key = np.bincount(run), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), key[first]
            keep = count >= np.minimum(2, floor[key[:, 1]])
            count, lo, hi, key = count[keep], lo[keep], hi[keep], key[keep]
            if not len(key):
                continue
            first, run = _grouped(key[:, :2])
            even, odd = (np.bincount(run, weights=count * (key[:, 2] % 2 == k), minlength=len(first)) for k in (0, 1))
            good = np.maximum(even, odd) >= floor[key[first, 1]]
            docs, items, spans = [], [], []
            ends = np.append(first[1:], len(key))
            for g in np.flatnonzero(good):
                s, e = first[g], ends[g]
                docs.append(key[s, 0])
                items.append(ids[key[s, 1]])
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo[s:e], hi[s:e])])
            if docs:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs)), pa.array(items, pa.int64()), pa.array(spans, span)], ["doc_id", "item_id", "spans"])

    return index.select("doc_id", "terms").mapInArrow(find, schema)


def aligned(passage: list[str], text: list[str], least: int | None = None) -> set[int]:
    """The places of the passage's words that lie in local alignments of at least `least` points with the text."""
    least = min(LEAST, max(1, 3 * len(passage) // 4)) if least is None else least
    if not passage or not text:
        return set()
    n, m = len(passage), len(text)
    ids = {w: k for k, w in enumerate(dict.fromkeys(passage))}
    a, b = np.array([ids[w] for w in passage]), np.array([ids.get(w, -1) for w in text])
    same = np.where(a[:, None] == b[None, :], 1, -1).astype(np.int32)
    best, steps = np.zeros((n + 1, m + 1), np.int32), np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = best[i]
        np.maximum(best[i - 1, :-1] + same[i - 1], best[i - 1, 1:] - 1, out=row[1:])
        np.maximum(row, 0, out=row)
        np.maximum(np.maximum.accumulate(row + steps) - steps, 0, out=row)
    open_, got = best.copy(), set()
    while True:
        i, j = divmod(int(open_.argmax()), m + 1)
        if open_[i, j] < least:
            return got
        end_i, end_j = i, j
        while i > 0 and j > 0 and best[i, j] > 0:
            if best[i, j] == best[i - 1, j - 1] + same[i - 1, j - 1]:
                i, j = i - 1, j - 1
                if same[i, j] > 0:
                    got.add(i)
            elif best[i, j] == best[i - 1, j] - 1:
                i -= 1
            else:
                j -= 1
        open_[:, j : end_j + 1] = 0
        open_[i + 1 : end_i + 1] = 0


def windows(spans: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The surroundings of the spans, overlapping ones as one, in pieces of bounded length that overlap by `reach`."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, lo - reach), hi + reach + 2) for lo, hi in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(s, min(hi, s + 8 * reach)) for lo, hi in out for s in range(lo, max(lo + 1, hi - 2 * reach), 6 * reach)]


def leaks(corpus: DataFrame, items: DataFrame, index: DataFrame | None = None, block: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, item_id, share, kind, lo, hi) of the documents that hold at least SHARE of an item's passage; lo and hi are word numbers."""
    index = build_index(corpus) if index is None else index
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").where("trim(passage) <> ''").dropDuplicates(["item_id"])
    pairs = written(item_pairs(items))
    blocks = max(1, -(-pairs.count() // block))
    out = None
    for k in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        # Bounded by the block: the pairs of these passages, not of the corpus.
        wanted = np.array(sorted(r.term for r in mine.select("term").distinct().collect()), np.int32)
        if not len(wanted):
            continue
        probes = [(r.item_id, r.i, r.term) for r in rarest_probes(mine, frequencies(index, wanted)).collect()]
        if probes:
            c = candidates(index, probes)
            out = c if out is None else out.unionByName(c)
    schema = "doc_id bigint, item_id bigint, share double, kind string, lo int, hi int"
    if out is None:
        return corpus.sparkSession.createDataFrame([], schema)
    # The candidates are few against the corpus; written, their true size decides how they meet the texts.
    texts = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("trim(text) <> ''")
    both = written(out).join(items, "item_id").join(texts, "doc_id").select("doc_id", "item_id", "passage", "text", "spans")

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, item, passage, text, spans in b.itertuples(index=False):
                p, t = words(passage), words(text)
                got: set[int] = set()
                exact = -1
                for lo, hi in windows([(s["lo"], s["hi"]) for s in spans], len(p) + MARGIN):
                    w = t[lo:hi]
                    got |= aligned(p, w)
                    if exact < 0 and len(got) == len(p):
                        exact = next((lo + j for j in range(len(w) - len(p) + 1) if w[j] == p[0] and w[j : j + len(p)] == p), -1)
                at = (exact, exact + len(p)) if exact >= 0 else (min(s["lo"] for s in spans), max(s["hi"] for s in spans) + 2)
                rows.append((doc, item, len(got) / len(p), "exact" if exact >= 0 else "proximity", *at))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "kind", "lo", "hi"])
            yield out[out.share >= SHARE]

    found = both.mapInPandas(check, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "kind", "lo", "hi")).alias("m")).select("doc_id", "item_id", "m.*")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its share, kind and place in words."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents leak each item, how many of them wholly, and the largest share, by suite."""
    items = read(spark, sf_dir, "eval_items")
    suite = items.groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("suite").alias("suite"))
    return leaks(read(spark, sf_dir, "documents"), items).join(suite, "item_id").groupBy("suite", "item_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("kind") == "exact").alias("n_exact"), F.max("share").alias("share"))


QUERIES = {"p8_found": p8_found, "p8_matches": p8_matches, "p8_by_suite": p8_by_suite}
ORACLE: dict[str, str] = {}
