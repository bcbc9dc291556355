"""Where models plug in: protocols, prompts without and with sample values, checks of answers, and embedding by batches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def __call__(self, prompt: str) -> str: ...


class OcrEngine(Protocol):
    def __call__(self, image: bytes, language: str) -> list[dict[str, Any]]: ...


class VisionModel(Protocol):
    def __call__(self, image: bytes, prompt: str) -> dict[str, Any]: ...


class HashingEmbedder:
    """Signed feature hashing of words at unit length: deterministic, needs no model, and alike texts come out near."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(chunks: DataFrame, make: Callable[[], Embedder], text: str = "chunk", batch: int = 64) -> DataFrame:
    """chunks with `vector`. make() builds the model once in each task; a batch that fails gives null vectors and a code."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is worked on at once is a batch of the model, not one of Arrow: ten thousand vectors as lists take a gigabyte in places.
        model = make()
        for frame in frames:
            for lo in range(0, frame.num_rows, batch):
                part = frame.slice(lo, batch)
                texts = [t or "" for t in part.column(text).to_pylist()]
                try:
                    found = model(texts)
                    if any(len(v) != model.dimension for v in found) or len(found) != len(texts):
                        raise ValueError("dimension")
                    vectors, error = pa.array(found, pa.list_(pa.float64())), None
                except Exception:
                    vectors, error = pa.nulls(len(texts), pa.list_(pa.float64())), "E_BACKEND_EMBED_FAILED"
                yield pa.RecordBatch.from_arrays([*part.columns, vectors, pa.array([error] * len(texts), pa.string())], names=[*part.schema.names, "vector", "embed_error"])

    return chunks.mapInArrow(run, f"{schema}, vector array<double>, embed_error string")


def sheet_summary(profile: DataFrame, with_values: bool = False) -> DataFrame:
    """A prompt's lines for each sheet: structure, and cells as their kinds, or as values if that is allowed.

    profile: file, sheet, n_rows, n_cols, numeric_ratio, sample (array of arrays of strings).
    """
    kind = lambda v: F.when(F.coalesce(F.trim(v), F.lit("")) == "", "empty").when(v.rlike("^[+-]?\\d+$"), "int").when(v.try_cast("double").isNotNull(), "float").otherwise("str")
    shown = (lambda v: F.coalesce(v, F.lit(""))) if with_values else kind
    rows = F.array_join(F.transform("sample", lambda r: F.concat(F.lit("  "), F.array_join(F.transform(r, shown), " | "))), "\n")
    head = F.format_string("Sheet %s: %d rows, %d columns, %.2f numeric", "sheet", "n_rows", "n_cols", "numeric_ratio")
    return profile.select("file", "sheet", F.concat(head, F.lit("\n"), rows).alias("summary"))


def document_summary(pages: DataFrame, most: int = 10) -> DataFrame:
    """A prompt's lines for the most telling pages of each document. pages: doc, page, page_type, n_words, n_tables, image_coverage."""
    from docloom.operators.pages import diverse_pages

    line = F.format_string("Page %d: %s, %d words, %d tables, %.2f images", "page", "page_type", "n_words", "n_tables", "image_coverage")
    chosen = diverse_pages(pages, most).withColumn("line", line)
    return chosen.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def checked_answer(answer: Column, types: list[str]) -> Column:
    """A model's JSON answer as (type, confidence within 0 to 1, reasoning, error): what isn't JSON or names no known type is an error."""
    parsed = F.from_json(answer, "type string, confidence double, reasoning string")
    known = parsed["type"].isin(*types)
    error = F.when(F.try_parse_json(answer).isNull(), "E_LLM_MALFORMED_JSON").when(~F.coalesce(known, F.lit(False)) | parsed["confidence"].isNull(), "E_LLM_SCHEMA_INVALID")
    return F.struct(
        F.when(error.isNull(), parsed["type"]).alias("type"), F.when(error.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"]))).alias("confidence"), F.when(error.isNull(), parsed["reasoning"]).alias("reasoning"), error.alias("error")
    )


def classify(summaries: DataFrame, make: Callable[[], LanguageModel], types: list[str], retries: int = 2) -> DataFrame:
    """summaries (with `summary`) with answer_type, confidence, reasoning and error; a bad answer is asked for again with a hint."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summaries.schema)

    def one(model: LanguageModel, summary: str) -> tuple[str | None, float | None, str | None, str | None]:
        hint, error = "", "E_LLM_FAILED"
        for _ in range(retries + 1):
            try:
                answer = json.loads(model(f"{summary}\nAnswer in JSON with type (one of {', '.join(types)}), confidence and reasoning.{hint}"))
                if answer["type"] in types:
                    return answer["type"], min(1.0, max(0.0, float(answer["confidence"]))), str(answer.get("reasoning", "")), None
                error, hint = "E_LLM_SCHEMA_INVALID", f" {answer['type']!r} is no such type."
            except (ValueError, TypeError, KeyError):
                error, hint = "E_LLM_MALFORMED_JSON", " The last answer wasn't valid JSON."
            except Exception:
                error = "E_LLM_FAILED"
        return None, None, None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            found = [one(model, s) for s in frame["summary"]]
            yield frame.assign(**{name: pd.Series([f[k] for f in found], index=frame.index, dtype=object) for k, name in enumerate(("answer_type", "answer_confidence", "reasoning", "llm_error"))}).astype({"answer_confidence": "float64"})

    return summaries.mapInPandas(run, f"{schema}, answer_type string, answer_confidence double, reasoning string, llm_error string")


def escalated(rules: DataFrame, summaries: DataFrame, keys: list[str], basic: Callable[[], LanguageModel], strong: Callable[[], LanguageModel], types: list[str], rule_min: float = 0.8, basic_min: float = 0.6) -> DataFrame:
    """Rules, then a model for what they leave open, then a stronger one. rules: keys, type, confidence.

    If both models fail, the rule's result stays, marked as degraded.
    """
    settled = rules.filter(F.col("confidence") >= rule_min).select(*keys, "type", "confidence", F.lit("rule_based").alias("tier"), F.lit(False).alias("degraded"))
    open_ = rules.filter(F.coalesce("confidence", F.lit(0.0)) < rule_min).join(summaries, keys)
    first = classify(open_, basic, types)
    good = first.filter((F.col("answer_confidence") >= basic_min)).select(*keys, F.col("answer_type").alias("type"), F.col("answer_confidence").alias("confidence"), F.lit("llm_basic").alias("tier"), F.lit(False).alias("degraded"))
    weak = first.filter(F.coalesce("answer_confidence", F.lit(0.0)) < basic_min).select(*open_.columns)
    second = classify(weak, strong, types)
    failed = F.col("answer_type").isNull()
    last = second.select(*keys, F.when(failed, F.col("type")).otherwise(F.col("answer_type")).alias("type"), F.when(failed, F.col("confidence")).otherwise(F.col("answer_confidence")).alias("confidence"), F.when(failed, "rule_based").otherwise("llm_reasoning").alias("tier"), failed.alias("degraded"))
    return settled.unionByName(good).unionByName(last)
