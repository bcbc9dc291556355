import io

import pytest
from pyspark.sql import functions as F

from docloom.operators import pages, stores
from docloom.sources import files


def test_upsert_and_versions(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path))
    frame = lambda *r: spark.createDataFrame(list(r), "id string, n int")
    assert not store.exists("t")
    store.upsert("t", frame(("a", 1), ("b", 2)), "id")
    store.upsert("t", frame(("b", 3), ("c", 4)), "id")
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    store.delete("t", frame(("a", 0)), "id")
    assert store.read("t").count() == 2 and store.columns("t") == [("id", "string"), ("n", "int")]
    store.drop("t")
    assert not store.exists("t")


def test_dual_write_and_rollback(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path))
    chunks = spark.createDataFrame([("c1", "x")], "id string, text string")
    good, bad = spark.createDataFrame([("r1", 1)], "row_id string, n int"), spark.createDataFrame([(1,)], "n int")
    assert stores.dual_write(store, chunks, good, "run1").errors == []
    partial = stores.dual_write(store, chunks.withColumn("id", F.lit("c2")), bad, "run2")
    assert partial.errors[-1] == "W_PARTIAL_WRITE" and store.read("chunks").count() == 2
    undone = stores.dual_write(store, chunks.withColumn("id", F.lit("c3")), bad, "run3", atomic=True)
    assert undone.fully_rolled_back and {r["id"] for r in store.read("chunks").collect()} == {"c1", "c2"}


def test_retries():
    tries, waits = [], []

    def fails():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        stores.with_retries(fails, 2, 1.0, waits.append)
    assert len(tries) == 3 and waits == [1.0, 2.0]


def test_identifiers():
    assert stores.safe_identifier("a" * 70, ["a" * 63]) == "a" * 61 + "_2"
    with pytest.raises(ValueError, match="identifier"):
        stores.safe_identifier("1; drop")


def test_files_and_scans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "d.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452000001000000008000") + b"rest")
    found = files.read_files(spark, str(tmp_path))
    codes = {r["path"][-5:]: r["code"] for r in found.select("path", files.scan(F.col("content"), F.col("path"), "pdf").alias("code")).collect()}
    assert codes == {"a.pdf": None, "b.pdf": "E_SECURITY_BAD_MAGIC", "d.png": "E_SECURITY_BAD_EXTENSION"}
    size = found.filter("format = 'image'").select(files.image_size(F.col("content")).alias("s")).first()["s"]
    assert (size["width"], size["height"]) == (256, 128)


def test_similar_headers_are_stripped(spark):
    sheets = spark.createDataFrame([(1, p, f"Report page {p}\nbody {p * 7}\nend") for p in range(1, 5)], "doc long, page int, text string")
    zones = sheets.select("doc", "page", F.lit("header").alias("zone"), F.substring_index("text", "\n", 1).alias("text"))
    left = pages.strip_lines(sheets, pages.repeated_zones(zones)).orderBy("page").collect()
    assert [r["text"] for r in left] == [f"body {p * 7}\nend" for p in range(1, 5)]


def test_partition_writer(spark, tmp_path):
    def send(folder, rows):
        for r in rows:
            io.open(f"{folder}/{r['id']}", "w").close()

    stores.write_partitions(spark.range(100).select("id"), lambda: str(tmp_path), send, batch=7)
    assert len(list(tmp_path.iterdir())) == 100
