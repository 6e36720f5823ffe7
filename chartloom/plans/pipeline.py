"""The engine's three plans, each over any number of persons at once.

pages -> facts -> charts (`ingest`); charts x questions -> answers (`ask`); a synthetic cohort -> measures (`benchmark`).
What feeds several branches is written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators import chart, claims, evaluation, extraction, questions
from chartloom.operators.prose import prose_facts
from chartloom.session import written


def ingest(pages: DataFrame, analytes: DataFrame, client: Callable[[str], Any] | None = None) -> DataFrame:
    """Facts of all pages by rules, and of narrative pages by the client where one is given."""
    f = extraction.parsed(pages, analytes)
    if client is None:
        return f
    p = prose_facts(pages, client).select("doc_id", "page_no", "kind", "name", "value", "unit", "time_iso", "loinc", "char_start", "char_end")
    return f.unionByName(p)


def ask(facts: DataFrame, analytes: DataFrame, asked: list[tuple[int, str]], priority: list[str], pairs: list[tuple] = dims.INTERACTIONS) -> DataFrame:
    """(pid, qid, intent, refused, reason, n_published, ...) of the questions (qid, text) for every person of the facts."""
    n = written(chart.nodes(facts, analytes))
    cov = written(questions.coverage(n, asked))
    c, k = claims.claims(n, cov, priority, pairs)
    return claims.answers(cov, claims.decided(claims.verified(written(c), written(k), n)))


def benchmark(spark: SparkSession, persons: int) -> DataFrame:
    """Planted and detected findings of a synthetic cohort by type and noise level."""
    analytes = dims.rows(spark, dims.ANALYTES, "loinc string, display string, unit string, ref_low double, ref_high double, hi_is_worse boolean")
    n = written(chart.nodes(evaluation.cohort(spark, persons), analytes))
    truth = written(evaluation.planted(n, dims.INTERACTIONS))
    out = None
    for level in evaluation.LEVELS:
        found = evaluation.planted(evaluation.perturbed(n, F.lit(level)), dims.INTERACTIONS)
        d = evaluation.detection(truth, found).withColumn("level", F.lit(level))
        out = d if out is None else out.unionByName(d)
    return out
