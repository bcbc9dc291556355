"""The pipeline's stages against what they should do to a small table, and the queries with SQL against it."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_operators import classes_of, deduped  # noqa: E402

import corpus_pipeline  # noqa: E402
from docloom.llm import decontaminate, packing, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, sf_dir, name):
    from util import rows

    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    texts = dict(zip(docs["doc_id"], docs["text"]))
    # No document of this table is far from all languages; the others stages by brute force, one after the other.
    left = {i: t for i, t in deduped(sorted(texts.items())).items() if t}
    ids = sorted(left)
    kept = [ids[c] for c in sorted(set(classes_of([left[i] for i in ids])))]
    frame = spark.createDataFrame([(i, left[i]) for i in kept], "doc_id long, text string")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.contaminated(frame, benchmark).collect()}
    tokens = packing._tokens(queries.word_tokenizer())
    want = {i: len(tokens.encode(left[i])) // 4 + 1 for i in kept if i not in bad}
    found = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert found.groupby("doc_id")["length"].sum().to_dict() == want


def test_stages_keep_columns_and_stand_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), sf_dir).columns == docs.columns, name
        assert stage(spark, empty, sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0


def test_null_rows_pass_through_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "some words of no language", None, None, None), (5, None, "en", "s", 0), (6, "", "en", "s", 0), (6, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(20).unionByName(odd), sf_dir).count() >= 20
