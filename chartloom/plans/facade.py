"""The engine's services over a folder of tables, each as a DataFrame of all or of one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators import chart, claims, graph, questions, registry
from chartloom.operators.facts import person_key
from chartloom.operators.texts import page_rows
from chartloom.plans import pipeline
from chartloom.session import written
from chartloom.sources.tables import read


class NotFound(LookupError):
    """No such patient, document or page."""


@dataclass(frozen=True)
class Engine:
    """Tables under `path`; `priority` and `pairs` are the analytes and drug pairs that questions look at."""

    spark: SparkSession
    path: str
    priority: tuple[str, ...] = tuple(questions.TEST_PRIORITY)
    pairs: tuple[tuple, ...] = tuple(dims.TEST_INTERACTIONS)

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.path, name)

    def status(self) -> DataFrame:
        return registry.service_status(self.spark, self.path)

    def patients(self) -> DataFrame:
        return registry.patient_record(self.spark, self.path)

    def patient(self, key: str) -> DataFrame:
        return self._one(self.patients().where(person_key(F.col("id")) == key.strip().lower()), f"patient {key!r}")

    def register(self, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) create requests, the rejected with their reasons."""
        status = written(registry.accepted(self.table("patients"), payloads))
        v = registry.validated(payloads).drop("reason").join(status, "payload_id")
        return v.where("status = 'created'").drop("status"), v.where("status <> 'created'")

    def update(self, changes: DataFrame) -> DataFrame:
        return registry.updated(self.table("patients"), changes)

    def attach(self, attach: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts, charts): all facts under their new persons, and the charts of the persons that this touches."""
        facts = self.table("facts")
        moved = registry.reattributed(facts, attach)
        mine = moved.withColumn("pid", person_key(F.col("patient_id"))).join(registry.touched(facts, attach), "pid", "left_semi").drop("pid")
        return moved, chart.nodes(mine, self.table("analytes"))

    def documents(self, key: str | None = None) -> DataFrame:
        d = self.table("documents").withColumn("pid", person_key(F.col("patient_id")))
        return d if key is None else d.where(F.col("pid") == key.strip().lower())

    def page(self, doc_id: int, page_no: int) -> DataFrame:
        """The page's text with the facts that point into it."""
        at = (F.col("doc_id") == doc_id) & (F.col("page_no") == page_no)
        p = self._one(page_rows(self.table("pages").where(at)), f"page {doc_id}/{page_no}")
        f = self.table("facts").where(at).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "kind", "name", "value"))).alias("spans"))
        return p.join(f, ["doc_id", "page_no"], "left")

    def nodes(self, key: str | None = None) -> DataFrame:
        # The person's facts are chosen before the chart is built.
        f = self.table("facts") if key is None else self.table("facts").where(person_key(F.col("patient_id")) == key.strip().lower())
        return chart.nodes(f, self.table("analytes"))

    def edges(self, key: str | None = None) -> DataFrame:
        return graph.chart_edges(self.nodes(key), list(self.pairs))

    def ingest(self, pages: DataFrame) -> DataFrame:
        return pipeline.ingest(pages, self.table("analytes"))

    def ask(self, asked: list[tuple[int, str]], key: str | None = None) -> DataFrame:
        f = self.table("facts") if key is None else self.table("facts").where(person_key(F.col("patient_id")) == key.strip().lower())
        return pipeline.ask(f, self.table("analytes"), asked, list(self.priority), list(self.pairs))

    def trace(self, pid: str, qid: int, no: int) -> DataFrame:
        """The decided claim of an audit row with what it cites."""
        n = written(self.nodes(pid))
        cov = questions.coverage(n)
        c, k = claims.claims(n, cov, list(self.priority), list(self.pairs))
        mine = (F.col("pid") == pid.strip().lower()) & (F.col("qid") == qid) & (F.col("no") == no)
        return claims.decided(claims.verified(c.where(mine), k.where(mine), n))

    @staticmethod
    def _one(df: DataFrame, what: str) -> DataFrame:
        if df.isEmpty():
            raise NotFound(f"no {what}")
        return df
