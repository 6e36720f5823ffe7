"""Facts out of narrative by a model, taken only where the text itself bears them out.

The client is any function from a page's text to a payload (a dict, or its JSON text); without one there are no facts,
and a client that fails costs its page's facts, never the query. A payload is used only if all of its items follow the
protocol. Each item's phrase must stand in the text, searched from where the last one ended and else from the begin; a
speculative clause gives nothing, and a negated clause makes the fact a stance, whatever the model said. Pages are
independent rows, so no shuffle is needed. Defined results: null and blank pages, malformed payloads and items whose
phrase is not in the text give nothing.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions.text import NEGATION, SPECULATION
from chartloom.operators.texts import page_rows
from chartloom.sources.tables import read

# What a model may call a kind of fact.
KINDS = {
    "symptom": "note_stance", "finding": "note_stance", "negation": "note_stance", "observation": "note_stance", "condition": "dx", "diagnosis": "dx", "medication": "med", "drug": "med", "lab": "lab", "laboratory": "lab",
    "result": "lab", "vital": "vital", "allergy": "allergy", "imaging": "imaging", "note_stance": "note_stance", "dx": "dx", "med": "med",
}
#: Characters of a page that a model is shown; facts are still located in the whole text.
SHOWN = 12_000
OUT = "doc_id bigint, page_no int, kind string, name string, value double, unit string, time_iso string, loinc string, code string, category string, negated boolean, reported_as string, char_start int, char_end int"
_NEGATED = re.compile(rf"(?:^| )(?:{'|'.join(NEGATION)})")
_CODE_AT_END, _CODE = re.compile(r"\(([A-Z]\d{2}(?:\.\d+)?)\)\s*$"), re.compile(r"\b([A-Z]\d{2}(?:\.\d+)?)\b")
_CONDITIONS = {c: (d, k) for c, d, k in dims.CONDITIONS}
_LOINC = {" ".join(d.lower().split()): c for c, d, *_ in dims.ANALYTES}


def stance(sentence: str) -> str:
    low = sentence.lower()
    if any(c in low for c in SPECULATION):
        return "SPECULATIVE"
    return "NEGATED" if _NEGATED.search(" ".join(re.findall("[a-z]+", low))) else "ASSERTED"


def clause(text: str, start: int, end: int) -> str:
    """What stands around a span up to the next sentence marks or line ends."""
    left = max((text.rfind(c, 0, start) for c in ".!?;:\n"), default=-1) + 1
    right = min((i for c in ".!?;:\n" if (i := text.find(c, end)) >= 0), default=len(text))
    return text[left:right]


def checked(payload: Any) -> list[dict] | None:
    """The payload's items in one shape; None if the payload or any item is malformed."""
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            return None
    items = payload.get("facts") if isinstance(payload, dict) else None
    if not isinstance(items, list):
        return None
    out = []
    for i in items:
        if not isinstance(i, dict):
            return None
        kind = KINDS.get(i["kind"].strip().lower()) if isinstance(i.get("kind"), str) else None
        texts = [i.get("name"), i.get("phrase")]
        meta, negated = i.get("meta"), i.get("negated", False)
        if kind is None or not all(isinstance(t, str) and t.strip() for t in texts) or not isinstance(negated, bool) or not (meta is None or isinstance(meta, dict)):
            return None
        out.append({"kind": kind, "name": texts[0].strip(), "phrase": texts[1].strip(), "negated": negated, "meta": meta or {}, "value": _number(i.get("value")), "unit": _text(i.get("unit")), "time": _text(i.get("timestamp"))})
    return out


def _text(x: Any) -> str | None:
    return x.strip() if isinstance(x, str) and x.strip() else None


def _number(x: Any) -> float | None:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    try:
        return float(x.strip().lstrip("<>") if isinstance(x, str) else x)
    except ValueError:
        return None


def _diagnosis(i: dict) -> tuple[str, str | None, str]:
    """Name, code and category: a declared code, else one in brackets at the end, else any in the phrase."""
    code, name = _text(i["meta"].get("code")), i["name"]
    if code is None and (m := _CODE_AT_END.search(name) or _CODE_AT_END.search(i["phrase"])):
        code, name = m[1], _CODE_AT_END.sub("", name).strip() or name
    if code is None and (m := _CODE.search(i["phrase"])):
        code = m[1]
    if name.upper() in _CONDITIONS:
        name = _CONDITIONS[name.upper()][0]
    known = _CONDITIONS.get(code or "", (None, None))[1]
    return name, code, known or _text(i["meta"].get("category")) or "unspecified"


def page_facts(text: str, items: list[dict]) -> list[tuple]:
    """(kind, name, value, unit, time, loinc, code, category, negated, reported_as, start, end) of the items that the text bears out."""
    out, cursor = [], 0
    for i in items:
        start = text.find(i["phrase"], cursor)
        start = start if start >= 0 else text.find(i["phrase"])
        if start < 0:
            continue
        cursor = end = start + len(i["phrase"])
        s = stance(clause(text, start, end))
        if s == "SPECULATIVE":
            continue
        negated = i["negated"] or s == "NEGATED"
        name, code, category = _diagnosis(i) if i["kind"] == "dx" else (i["name"], None, None)
        loinc = _LOINC.get(" ".join(name.lower().split())) if i["kind"] == "lab" else None
        kind, was = ("note_stance", i["kind"]) if negated and i["kind"] != "note_stance" else (i["kind"], None)
        out.append((kind, name, i["value"], i["unit"], i["time"], loinc, code, category, negated, was, start, end))
    return out


def prose_facts(pages: DataFrame, client: Callable[[str], Any] | None) -> DataFrame:
    """Facts (OUT) of pages (doc_id, page_no, text[, payload]); a payload column is used before the client is asked."""
    p = pages if "payload" in pages.columns else pages.withColumn("payload", F.lit(None).cast("string"))

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, page, text, payload in b.itertuples(index=False):
                try:
                    got = payload if payload is not None else client(text[:SHOWN]) if client else None
                except Exception:  # noqa: BLE001 - a client may fail in any way
                    got = None
                out += [(doc, page, *f) for f in page_facts(text, checked(got) or [])]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return p.where("trim(text) <> ''").select("doc_id", "page_no", "text", "payload").mapInPandas(rows, OUT)


def remembered(prompts: DataFrame, cache: DataFrame, ask: Callable[[str], str | None], model: str) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): prompts (prompt) with answers from a cache table (key, answer) by hash of model and prompt; only misses are asked, for appending to the cache."""
    keyed = prompts.select("prompt", F.sha2(F.concat_ws("\x1f", F.lit(model), "prompt"), 256).alias("key")).distinct()

    def fetch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "prompt": b["prompt"], "answer": [ask(p) for p in b["prompt"]]})

    misses = keyed.join(cache, "key", "left_anti").mapInPandas(fetch, "key string, prompt string, answer string")
    return keyed.join(cache, "key").select("key", "prompt", "answer").unionByName(misses), misses.select("key", "answer")


def payload_of(answer: str | None) -> Any:
    """The JSON object of a model's answer, without code fences and what stands around it; None without one."""
    t = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", answer or "")
    for body in (t, t[t.find("{") : t.rfind("}") + 1]):
        try:
            got = json.loads(body)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


class Unavailable(Exception):
    """A failure of a model's service that another attempt may mend: too many requests, a server's fault, a timeout."""


def retrying(ask: Callable[[str], str], attempts: int = 3, waits: tuple[float, ...] = (1, 2, 4), sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Any]:
    """A client of `ask`: payloads as objects, temporary failures asked again after waits, one more turn for an answer that is no JSON."""

    def turn(prompt: str) -> str:
        for k in range(attempts):
            try:
                return ask(prompt)
            except Unavailable:
                if k + 1 == attempts:
                    raise
                sleep(waits[min(k, len(waits) - 1)])
        raise Unavailable

    def client(prompt: str) -> Any:
        got = payload_of(turn(prompt))
        return got if got is not None else payload_of(turn(prompt + "\n\nAnswer with one JSON object and nothing else."))

    return client


def scrubbed(c, secrets: list[str]):
    """A message without secrets: keys after 'Bearer' or 'key=', and the given words."""
    out = F.regexp_replace(c, r"(?i)(bearer\s+|(?:api[_-]?)?key=)[^\s&\"']+", "$1***")
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("***"))
    return out


def prose_from_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The model's stored diagnoses of the tables as payloads of their pages, taken through the same checks."""
    f = read(spark, sf, "facts").where("extractor = 'llm' and kind = 'dx' and char_end > char_start").select("doc_id", "page_no", "fact_id", "name", "char_start", "char_end")
    p = page_rows(read(spark, sf, "pages"))
    item = F.to_json(F.struct(F.lit("diagnosis").alias("kind"), "name", F.expr("substring(text, char_start + 1, char_end - char_start)").alias("phrase")))
    # A page's facts are bounded by the page.
    g = f.join(p, ["doc_id", "page_no"]).groupBy("doc_id", "page_no").agg(F.first("text").alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "fact_id", item.alias("item")))), lambda x: x.item), ",").alias("items"))
    return prose_facts(g.select("doc_id", "page_no", "text", F.concat(F.lit('{"facts": ['), "items", F.lit("]}")).alias("payload")), None)


QUERIES = {"prose_from_stored": prose_from_stored}
ORACLE: dict[str, str] = {}
