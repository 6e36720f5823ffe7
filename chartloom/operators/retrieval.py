"""Lexical retrieval: overlapping chunks, tf-idf weights as known when a chunk came in, cosine and top-k.

Weights live in long rows (chunk, term, weight). The number of chunks and of a term's chunks at the time a chunk is
added are ranks over the order of insertion (ordered.ranked: buckets, so that a frequent term is not one task); the
query uses the final counts. There is no least score: a query that shares no term with any chunk gets the first chunks.
Defined results: null and blank texts give no chunk; a text of one long word is one chunk; equal scores go by order of
insertion; fewer chunks than k give fewer hits; empty tables give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import text as T
from chartloom.operators.ordered import ranked
from chartloom.operators.texts import tokens_sql
from chartloom.session import written
from chartloom.sources.tables import read

SIZE, OVERLAP, TOP = 800, 120, 4
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Invented questions, the last without any known word.
TEST_QUERIES = [
    ("q1", "Is there any medication interaction in the current regimen?"), ("q2", "thyroid and calcium results"), ("q3", "shortness of breath at night"), ("q4", "When was the last visit to cardiology?"), ("q5", "zzzq qqzz"), ("q6", ""),
]


def chunk_spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of whole words: a chunk takes the words that begin within `size` characters; the next begins `overlap` before its end, or one word on."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, i, n = [], 0, len(words)
    while i < n:
        end = i + 1
        while end < n and words[end][0] < words[i][0] + size:
            end += 1
        out.append((words[i][0], words[end - 1][1]))
        if end == n:
            break
        back = out[-1][1] - overlap
        # Never behind the word after i: each chunk makes progress.
        j = i + 1
        while j < n and words[j][0] < back:
            j += 1
        i = j
    return out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, page, n, char_start, char_end, body) of docs (doc_id, page, text): a recurrence over words, in Arrow batches."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, p, n, s, e, t[s:e]) for d, p, t in zip(*(c.to_pylist() for c in b.columns)) for n, (s, e) in enumerate(chunk_spans(t, size, overlap))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "page", "n", "char_start", "char_end", "body"])

    d = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page"), "text")
    return d.mapInArrow(cut, "doc_id bigint, page int, n int, char_start int, char_end int, body string")


def sequenced(parts: DataFrame, order: list[str]) -> DataFrame:
    """parts with seq, their 1-based place in the order (which begins with doc_id) over all documents."""
    p = parts.withColumn("all", F.lit(0)).withColumn("bucket", F.floor(F.col("doc_id") / 256))
    return ranked(p, ["all"], order, "bucket", "seq").drop("all", "bucket")


def term_counts(parts: DataFrame) -> DataFrame:
    """(seq, term, tf) of parts (seq, body)."""
    return parts.select("seq", F.explode(T.tokens(F.col("body"))).alias("term")).groupBy("seq", "term").agg(F.count("*").alias("tf"))


def running_df(tf: DataFrame) -> DataFrame:
    """(seq, term, tf, df): df counts the parts with the term up to and with this one."""
    return ranked(tf.withColumn("bucket", F.floor(F.col("seq") / 4096)), ["term"], ["seq"], "bucket", "df").drop("bucket")


def weight(tf: Column, df: Column, n: Column) -> Column:
    return (1.0 + F.log(tf.cast("double"))) * (F.log((n + 1.0) / (df + 1.0)) + 1.0)


def weights(tf: DataFrame) -> DataFrame:
    """(seq, term, w, norm): the weights as they were when each part was added, and the length of its vector."""
    w = running_df(tf).select("seq", "term", weight(F.col("tf"), F.col("df"), F.col("seq")).alias("w"))
    norm = w.groupBy("seq").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "seq")


def top_k(parts: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, seq, score, rank): the k best parts (seq, body) of each query (query_id, query)."""
    tf = written(term_counts(parts))
    w = weights(tf)
    total = parts.agg(F.count("*").alias("total"))
    q = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    final = tf.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("final"))
    # One row of totals.
    q = q.join(final, "term", "left").crossJoin(F.broadcast(total)).withColumn("qw", weight(F.col("qtf"), F.coalesce("final", F.lit(0)), F.col("total")))
    qnorm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    hit = w.join(q.select("query_id", "term", "qw"), "term").groupBy("query_id", "seq").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.max("norm").alias("norm"))
    hit = hit.join(qnorm, "query_id").select("query_id", "seq", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    hit = hit.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Parts without a common term score 0 and go by order: the first 2k at most can be among the k best.
    first = parts.select("seq").where(F.col("seq") <= 2 * k)
    rest = queries.select("query_id").crossJoin(F.broadcast(first)).join(hit.select("query_id", "seq"), ["query_id", "seq"], "left_anti").withColumn("score", F.lit(0.0))
    both = hit.select("query_id", "seq", "score").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _queries(spark: SparkSession) -> DataFrame:
    return dims.rows(spark, TEST_QUERIES, "query_id string, query string")


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as one part."""
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("body"))
    return sequenced(d.where("trim(body) <> ''"), ["doc_id"])


def q_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(read(spark, sf, "documents").withColumn("page", F.lit(1))).select("doc_id", "n", "char_start", "char_end")


def term_df_running(spark: SparkSession, sf: str) -> DataFrame:
    return running_df(term_counts(_whole(spark, sf)))


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best whole documents of each query."""
    p = written(_whole(spark, sf))
    return top_k(p, _queries(spark)).join(p.select("seq", "doc_id"), "seq").select("query_id", "rank", "doc_id")


def chunk_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's best chunk as its answer, with the places of its hits; never a refusal."""
    c = written(sequenced(chunks(read(spark, sf, "documents").withColumn("page", F.lit(1))), ["doc_id", "n"]))
    h = top_k(c.select("seq", "body"), _queries(spark)).join(c, "seq")
    place = F.concat_ws("#", "doc_id", "n")
    return h.groupBy("query_id").agg(F.min_by("body", "rank").alias("answer"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", place.alias("p")))), lambda x: x.p), " ").alias("citations"), F.lit(False).alias("refused"))


_WHOLE = "parts as (select row_number() over (order by doc_id) seq, doc_id, text body from documents where text is not null and trim(text) <> '')"
_TF = f"tf as (select seq, term, count(*) tf from (select seq, unnest({tokens_sql('body')}) term from parts) group by 1, 2), rd as (select *, row_number() over (partition by term order by seq) df from tf)"
_TOP = f"""qs(query_id, query) as ({dims.sql_rows(TEST_QUERIES)}), tot as (select count(*) total from parts),
w as (select *, (1.0 + ln(tf)) * (ln((seq + 1.0) / (df + 1.0)) + 1.0) w from rd), nm as (select seq, sqrt(sum(w * w)) norm from w group by 1),
qt as (select query_id, term, count(*) qtf from (select query_id, unnest({tokens_sql('query')}) term from qs) group by 1, 2),
qw as (select qt.*, (1.0 + ln(qtf)) * (ln((total + 1.0) / ((select count(*) from tf where tf.term = qt.term) + 1.0)) + 1.0) qw from qt, tot), qn as (select query_id, sqrt(sum(qw * qw)) qnorm from qw group by 1),
sc as (select query_id, seq, sum(w * qw) dot from w join qw using (term) group by 1, 2),
al as (select qs.query_id, parts.seq, doc_id, coalesce(round(dot / (norm * qnorm), 9), 0) score from qs cross join parts left join sc on sc.query_id = qs.query_id and sc.seq = parts.seq left join nm on nm.seq = parts.seq left join qn on qn.query_id = qs.query_id)"""
_SPACE = r"[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+"
QUERIES = {"chunks": q_chunks, "term_df_running": term_df_running, "tfidf_topk": tfidf_topk, "chunk_answers": chunk_answers}
ORACLE = {
    "chunks": rf"""with recursive w0 as (select doc_id, unnest(x) t, generate_subscripts(x, 1) k from (select doc_id, regexp_extract_all(text, '{_SPACE}') x from documents where text is not null) z),
        w1 as (select *, cast(sum(length(t)) over (partition by doc_id order by k) as integer) e from w0),
        d as (select doc_id, list(e - length(t) order by k) s, list(e order by k) e from w1 where not regexp_matches(t, '^[ \t\n\r\x0b\x0c]') group by 1),
        c(doc_id, n, i, j) as (
          select doc_id, 0, 1, greatest(1, len(list_filter(s, lambda x: x < s[1] + {SIZE}))) from d
          union all
          select doc_id, n, i, greatest(i, len(list_filter(s, lambda x: x < s[i] + {SIZE}))) from (
            select c.doc_id, c.n + 1 n, greatest(c.i + 1, len(list_filter(d.s, lambda x: x < d.e[c.j] - {OVERLAP})) + 1) i, d.s from c join d on c.doc_id = d.doc_id where c.j < len(d.s)))
        select c.doc_id, cast(n as integer) n, cast(s[i] as integer) char_start, cast(e[j] as integer) char_end from c join d on c.doc_id = d.doc_id""",
    "term_df_running": f"with {_WHOLE}, {_TF} select seq, term, tf, df from rd",
    "tfidf_topk": f"with {_WHOLE}, {_TF}, {_TOP} select query_id, row_number() over (partition by query_id order by score desc, seq) rank, doc_id from al qualify rank <= {TOP}",
}
ORACLE["term_df_running"] = dims.as_integers(ORACLE["term_df_running"], "seq", "df")
ORACLE["tfidf_topk"] = dims.as_integers(ORACLE["tfidf_topk"], "rank")
