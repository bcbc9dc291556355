import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import image
from docloom.operators import models
from docloom.sources import config


def test_config_files(tmp_path):
    (tmp_path / "a.json").write_text('{"chunking": {"size_tokens": 100}, "tenant_id": "t"}')
    (tmp_path / "b.yaml").write_text("forms:\n  grid: [10, 8]\n")
    (tmp_path / "c.yml").write_text("")
    assert config.load(str(tmp_path / "a.json")).chunking.size_tokens == 100
    assert config.load(str(tmp_path / "b.yaml")).forms.grid == (10, 8)
    assert config.load(str(tmp_path / "c.yml")) == config.Config()
    with pytest.raises(ValueError, match="unknown"):
        config.from_dict({"chunking": {"sizes": 1}})
    with pytest.raises(ValueError, match="overlap"):
        config.from_dict({"chunking": {"size_tokens": 10, "overlap_tokens": 10}})


def test_limits_need_a_reason():
    with pytest.raises(ValueError, match="reject_javascript"):
        config.Limits(reject_javascript=False)
    assert config.Limits(max_pages=9000, override_reason="archive").max_pages == 9000
    assert config.Limits(max_pages=10).max_pages == 10


def test_embed(spark):
    class Fails:
        dimension = 4

        def __call__(self, texts):
            raise OSError

    chunks = spark.createDataFrame([("a b c",), ("a b d",), (None,)], "chunk string")
    v = [r["vector"] for r in models.embed(chunks.coalesce(1), lambda: models.HashingEmbedder(64), batch=2).collect()]
    assert np.dot(v[0], v[1]) > 0.5 and not any(v[2])
    assert {r["embed_error"] for r in models.embed(chunks, Fails).collect()} == {"E_BACKEND_EMBED_FAILED"}


def test_escalation(spark):
    def basic(prompt):
        return {"a": '{"type": "x", "confidence": 0.9}', "b": '{"type": "x", "confidence": 0.2}'}.get(prompt[0], "no JSON")

    def strong(prompt):
        if prompt[0] == "c":
            raise OSError
        return json.dumps({"type": "y", "confidence": 7, "reasoning": "r"})

    rules = spark.createDataFrame([(1, "x", 0.9), (2, "x", 0.0), (3, "y", 0.7), (4, "y", 0.7)], "doc int, type string, confidence double")
    summaries = spark.createDataFrame([(2, "a"), (3, "b"), (4, "c")], "doc int, summary string")
    found = {r["doc"]: (r["type"], r["confidence"], r["tier"], r["degraded"]) for r in models.escalated(rules, summaries, ["doc"], lambda: basic, lambda: strong, ["x", "y"]).collect()}
    assert found == {1: ("x", 0.9, "rule_based", False), 2: ("x", 0.9, "llm_basic", False), 3: ("y", 1.0, "llm_reasoning", False), 4: ("y", 0.7, "rule_based", True)}


def test_answers_and_summaries(spark):
    answers = spark.createDataFrame([('{"type": "x", "confidence": 3}',), ('{"type": "z", "confidence": 1}',), ("{",), (None,)], "a string")
    found = [r["c"] for r in answers.coalesce(1).select(models.checked_answer(F.col("a"), ["x"]).alias("c")).collect()]
    assert [(c["type"], c["confidence"], c["error"]) for c in found] == [("x", 1.0, None), (None, None, "E_LLM_SCHEMA_INVALID"), (None, None, "E_LLM_MALFORMED_JSON"), (None, None, "E_LLM_MALFORMED_JSON")]
    profile = spark.createDataFrame([("f", "s", 5, 3, 0.5, [["1", "x", None], ["1.5", "", "y"]])], "file string, sheet string, n_rows int, n_cols int, numeric_ratio double, sample array<array<string>>")
    kinds, values = (models.sheet_summary(profile, v).first()["summary"].split("\n")[1:] for v in (False, True))
    assert kinds == ["  int | str | empty", "  float | empty | str"] and values == ["  1 | x | ", "  1.5 |  | y"]


def test_images():
    page = np.full((64, 80), 255, dtype=np.uint8)
    page[8:16, 10:70] = 0
    assert image.dark_ratio(page) == pytest.approx(8 * 60 / page.size)
    grid = image.levels(page, 8, 8)
    assert grid.shape == (8, 8) and grid[1, 3] == 3 and grid[5].max() == 0
    tilted = image.rotate(page, 5)
    assert abs(image.deskew(tilted)[1] + 5) <= 1
    assert set(np.unique(image.adaptive_threshold(page))) <= {0, 255} and image.local_contrast(page).shape == page.shape
    assert image.otsu(np.full((4, 4), 9, dtype=np.uint8)) in (9, 127)
