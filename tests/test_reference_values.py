"""Rules of documents, forms and files at chosen values: where the limits are, and what comes first."""

import struct

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chains, forms, pages, retrieval, sheets, stores
from docloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value, kind="string"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(("confidence", "vlm", "want"), [(0.5, False, "accept"), (0.8, True, "accept"), (0.49, True, "warn"), (0.4, False, "warn"), (0.39, True, "vlm"), (0.39, False, "null"), (0.0, False, "null")])
def test_confidence_actions(spark, confidence, vlm, want):
    assert one(spark, text.confidence_action(F.lit(confidence), vlm)) == want


@pytest.mark.parametrize(("raw", "coerced", "native", "want"), [(1.0, True, True, 0.97), (1.0, False, True, 0.99), (0.5, False, True, 0.90), (0.5, True, True, 0.90), (0.91, True, True, 0.90), (1.2, True, False, 1.0), (0.45, True, False, 0.45), (-1.0, False, False, 0.0)])
def test_field_confidence(spark, raw, coerced, native, want):
    assert one(spark, text.field_confidence(F.lit(raw), F.lit(coerced), native)) == pytest.approx(want)


@pytest.mark.parametrize(("raw", "kind", "want"), [(" $1,234.50 ", "number", "1,234.50"), ("-7 kg", "number", "-7"), (" 1  May\n2020 ", "date", "1 May 2020"), ("  two  spaces ", "text", "two  spaces"), ("", "number", "")])
def test_ocr_values(spark, raw, kind, want):
    assert one(spark, text.ocr_value(lit(raw), lit(kind))) == want


@pytest.mark.parametrize("value", ["2024-01-15", "2024-1-5", "01/15/2024", "15/01/2024", "2024-01-15T10:30:00"])
def test_dates_stay_as_they_are(spark, value):
    assert one(spark, text.coerce_date(lit(value))) == value


@pytest.mark.parametrize("value", ["15.01.2024", "15-Jan-2024", "2024-02-30", "13/13/2024", "2024-01-15 ", "soon", "", None])
def test_no_dates(spark, value):
    assert one(spark, text.coerce_date(lit(value))) is None


def test_marks_and_widgets(spark):
    assert [one(spark, text.coerce_checkbox(lit(v))) for v in ("X", " yes ", "TRUE", "1", "on", "maybe", "", None)] == [True] * 4 + [False] * 4
    value = lambda v, kind: tuple(one(spark, text.widget_value(lit(v), lit(kind))))
    assert value("12.5", "number") == (12.5, None, None) and value("12 kg", "number") == (None, None, "12 kg") and value(None, "number") == (None, None, None)
    assert value("On", "checkbox")[1] is True and value(" on", "radio")[1] is False and value(None, "checkbox")[1] is False
    assert value(" ", "signature")[1] is False and value("J", "signature")[1] is True and value("a ", "text")[2] == "a "


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("com-\nplete 123-\n456", "complete 123-\n456"), ("Com-\r\nPlete", "ComPlete"), ("a  b\t\tc  \nd", "a\n"), ("x\n\n\n\ny I z", "\n\n I"), ("wait!!!! so.... ok...", "wait! so. ok..."),
        ("état", "état"), (" \n ", ""), ("", ""), ("I a A b word", "I a A word"), ("<<<<>>>> ==== ~~~", "<> = ~~~"),
    ],
)
def test_ocr_cleaning(spark, raw, want):
    assert one(spark, text.ocr_clean(lit(raw))) == want


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("Embedding request timed out", "E_BACKEND_EMBED_TIMEOUT"), ("qdrant timeout", "E_BACKEND_VECTOR_TIMEOUT"), ("Timeout", "E_BACKEND_DB_TIMEOUT"), ("cannot connect to embed", "E_BACKEND_EMBED_CONNECT"),
        ("collection connection lost", "E_BACKEND_VECTOR_CONNECT"), ("connection refused", "E_BACKEND_DB_CONNECT"), ("refused", "E_PROCESS_SCHEMA_GEN"),
    ],
)
def test_backend_errors(spark, message, want):
    assert one(spark, text.backend_error(lit(message))) == want


def test_scans(spark):
    scan = lambda t, path="a.json", **k: list(one(spark, files.scan_json(lit(t), lit(path), **k)))
    assert scan("{}") == [] and scan("{}", "a.txt") == ["E_SECURITY_BAD_EXTENSION"] and scan(None) == ["E_PARSE_CORRUPT"] and scan("") == ["E_PARSE_EMPTY"]
    assert scan("{") == ["E_SECURITY_INVALID_JSON"] and scan("[" * 101 + "]" * 101) == ["E_SECURITY_NESTING_BOMB"] and scan("[" * 100 + "]" * 100) == []
    assert scan('{"a": "[[[[ \\" ]"}', deepest=1) == [] and scan("[1, 22, 3]", largest=20, warn_at=5) == ["W_LARGE_FILE"] and scan("[1, 22, 3]", largest=5) == ["E_SECURITY_TOO_LARGE"]
    xml = lambda t, path="a.xml", **k: list(one(spark, files.scan_xml(lit(t), lit(path), **k)))
    assert xml("<a/>") == [] and xml("<!DOCTYPE a><a/>") == [] and xml("<a><b></a>") == ["E_SECURITY_INVALID_XML"] and xml("<a/>", "a.json") == ["E_SECURITY_BAD_EXTENSION"]
    assert xml("<!entity x 'y'><a/>") == ["E_SECURITY_ENTITY_DECLARATION"] and xml("<!DOCTYPE a [ ]><a/>") == ["E_SECURITY_ENTITY_DECLARATION"]
    assert xml("<a>" * 101 + "</a>" * 101) == ["E_SECURITY_DEPTH_BOMB"] and xml("<a><b/><b/></a>", most=2) == ["W_TRUNCATED"]


def test_image_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 40, 60) + b"\x01" + bytes(8)
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHIHxx", 256, 3, 1, 70) + struct.pack("<HHII", 257, 4, 1, 50)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (29).to_bytes(3, "little") + (19).to_bytes(3, "little") + bytes(4)
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 3, 4)
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate((jpeg, tiff, webp, png, b"nothing", b""))], "i int, b binary")
    found = {r["i"]: r["s"] and tuple(r["s"]) for r in rows.select("i", files.image_size(F.col("b")).alias("s")).collect()}
    assert found == {0: (60, 40), 1: (70, 50), 2: (30, 20), 3: (3, 4), 4: None, 5: None}


PAGE = {"doc": 1, "page": 1, "text": "x" * 300, "image_coverage": 0.0, "n_images": 0, "n_tables": 0, "n_fonts": 2, "n_widgets": 0, "multi_column": False}
PAGE_KIND = "doc int, page int, text string, image_coverage double, n_images int, n_tables int, n_fonts int, n_widgets int, multi_column boolean"


@pytest.mark.parametrize(
    ("change", "kind", "vote", "confidence"),
    [
        ({}, "TEXT", "text_native", 0.9), ({"image_coverage": 0.5}, "TEXT", "text_native", 0.7), ({"n_tables": 1}, "TABLE_HEAVY", "complex", 0.7), ({"n_tables": 2}, "TABLE_HEAVY", "complex", 0.7),
        ({"n_tables": 1, "n_widgets": 1}, "FORM", "complex", 0.9), ({"multi_column": True}, "MIXED", "complex", 0.7), ({"text": "abc", "n_fonts": 0}, "BLANK", "skip", 1.0),
        ({"text": "abc", "n_images": 1, "image_coverage": 0.9, "n_fonts": 0}, "SCANNED", "scanned", 0.9), ({"text": "x" * 100, "image_coverage": 0.5, "n_images": 1, "n_fonts": 1}, "TEXT", None, 0.0),
    ],
)
def test_page_votes(spark, change, kind, vote, confidence):
    row = pages.page_vote(pages.page_profile(spark.createDataFrame([tuple((PAGE | change).values())], PAGE_KIND))).first()
    assert (row["page_type"], row["vote"], row["vote_confidence"]) == (kind, vote, confidence)


def test_document_votes(spark):
    blank = PAGE | {"text": ""}
    docs = {1: [PAGE, PAGE], 2: [PAGE, PAGE | {"n_tables": 1}], 3: [blank, blank], 4: [PAGE, PAGE | {"text": "x" * 100, "image_coverage": 0.5, "n_images": 1}], 5: [PAGE, blank]}
    rows = [tuple((p | {"doc": d, "page": i}).values()) for d, ps in docs.items() for i, p in enumerate(ps)]
    found = {r["doc"]: (r["pdf_type"], r["confidence"]) for r in pages.document_vote(pages.page_vote(pages.page_profile(spark.createDataFrame(rows, PAGE_KIND)))).collect()}
    assert found == {1: ("text_native", 0.9), 2: ("complex", 0.9), 3: ("complex", 0.0), 4: ("complex", 0.0), 5: ("text_native", 0.9)}


def test_stitched_tables(spark):
    a, b = ["Name", "Qty", "Price", "Tax", "Sum"], ["Name", "Qty", "Price", "Tax", "Total"]
    far = ["Name", "Amount", "Price", "Tax", "Total"]
    rows = [(1, 1, 1, a, [["r1"]]), (1, 2, 1, b, [[x.upper() + " " for x in a], ["r2"]]), (1, 3, 1, far, [["r3"]]), (1, 3, 2, far, [["r4"]]), (1, 5, 1, far, []), (2, 1, 1, a[:2], [["r5"]])]
    tables = spark.createDataFrame(rows, "doc int, page int, table_no int, header array<string>, rows array<array<string>>")
    done = pages.stitch_tables(tables)
    assert {(r["page"], r["table_no"]): (r["continued"], r["group_no"]) for r in done.filter("doc = 1").collect()} == {(1, 1): (False, 1), (2, 1): (True, 1), (3, 1): (False, 2), (3, 2): (False, 3), (5, 1): (True, 3)}
    found = {(r["doc"], r["group_no"]): (r["pages"], r["header"], r["rows"]) for r in pages.stitched_rows(done).collect()}
    assert found[1, 1] == ([1, 2], a, [["r1"], ["r2"]]) and found[1, 3] == ([3, 5], far, [["r4"]]) and found[2, 1][2] == [["r5"]]


def test_descriptions_of_columns(spark):
    rows = spark.createDataFrame([(1, "b", 2.5, True, None), (2, "a", 1.5, False, None), (3, "b", None, True, None), (4, None, 3.0, None, None)], "n int, t string, x double, f boolean, e string").withColumn("d", F.expr("date_add(DATE'2024-01-01', n)"))
    found = {r["column_name"]: r["description"] for r in sheets.describe_columns(rows, ["n", "t", "x", "f", "e", "d"], "n").collect()}
    assert found == {"n": "range 1 to 4", "t": "one of b, a", "x": "range 1.5 to 3.0", "f": "true/false", "e": "no data", "d": "ranges from 2024-01-02 00:00:00 to 2024-01-05 00:00:00"}
    assert {r["description"] for r in sheets.describe_columns(rows, ["t"], "n", few=2).collect()} == {"2 unique values"}


def test_extractors_and_cells(spark):
    chosen = lambda f, w, n, o: tuple(one(spark, forms.choose_extractor(lit(f), F.lit(w), F.lit(n), F.lit(o))))
    assert chosen("xlsx", False, False, False) == ("cell_mapping", None) and chosen("pdf", True, True, False) == ("native_fields", None) and chosen("pdf", False, True, True) == ("ocr_overlay", None)
    assert chosen("pdf", True, False, True)[1] == "E_FORM_NATIVE_FIELDS_UNAVAILABLE" and chosen("image", False, True, False)[1] == "E_FORM_OCR_FAILED" and chosen(None, True, True, True)[1] == "E_FORM_UNSUPPORTED_FORMAT"
    cell = lambda v, r, d: tuple(one(spark, forms.cell_value(lit(v), F.lit(r), lit(d))))
    assert cell(" ", True, "d") == (None, 0.0, "W_FORM_FIELD_MISSING_REQUIRED") and cell(None, False, "d") == ("d", 0.95, None) and cell("v", True, "d") == ("v", 0.95, None)


def test_templates_are_kept_by_versions(spark, tmp_path):
    kept = stores.TemplateStore(stores.ParquetStore(spark, str(tmp_path)))
    kept.save(spark.createDataFrame([("a", 1, "draft"), ("b", 1, "draft")], "template string, version int, status string"))
    kept.save(spark.createDataFrame([("a", 2, "approved")], "template string, version int, status string"))
    with pytest.raises(ValueError, match="changed"):
        kept.save(spark.createDataFrame([("a", 2, "draft")], "template string, version int, status string"))
    kept.delete("a", 2)
    kept.delete("b")
    assert [tuple(r) for r in forms.latest_versions(*kept.tables()).select("template", "version").collect()] == [("a", 1)]


def test_two_writers_lose_no_update(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path))
    store.replace("t", spark.range(3))
    store.replace("t", spark.range(4), 1)
    with pytest.raises(stores.ConcurrentWrite):
        store.replace("t", spark.range(5), 1)
    assert store.read("t").count() == 4
    store.upsert("t", spark.range(3, 6), "id")
    assert store.read("t").count() == 6


def test_chains(spark, tmp_path):
    rows = [("a.json", '{"k": {"x": 1, "y": "two"}}'), ("b.json", ""), ("c.json", "{"), ("d.txt", "{}"), ("e.json", "{}"), ("f.json", None)]
    done = chains.process(spark.createDataFrame(rows, "uri string, text string"), "json")
    found = {r["uri"]: r for r in done.results.collect()}
    assert found["a.json"]["errors"] == [] and found["a.json"]["n_chunks"] == 1 and found["a.json"]["dimension"] == 256 and found["a.json"]["total"] == 2
    assert [found[u]["errors"] for u in ("b.json", "c.json", "d.txt", "f.json")] == [["E_PARSE_EMPTY"], ["E_SECURITY_INVALID_JSON"], ["E_SECURITY_BAD_EXTENSION"], ["E_PARSE_CORRUPT"]]
    assert found["b.json"]["ingest_key"] == "" and found["e.json"]["n_chunks"] == 0 and found["e.json"]["errors"] == []
    assert [r["chunk"] for r in done.chunks.collect()] == ["k.x: 1\nk.y: two"]
    totals = chains.run_totals(done.results).first()
    assert (totals["n_files"], totals["n_failed"], totals["n_chunks"]) == (6, 4, 1) and totals["codes"]["E_PARSE_EMPTY"] == 1
    store = stores.ParquetStore(spark, str(tmp_path))
    assert chains.write(done, store, "run").errors == [] and store.read("chunks").count() == 1 and store.read("results").count() == 6
    again = chains.process(spark.createDataFrame(rows[:1], "uri string, text string"), "json", known=done.results)
    assert again.chunks.count() == 0 and again.results.first()["warnings"] == ["W_ALREADY_INGESTED"]
    xml = chains.process(spark.createDataFrame([("a.xml", "<a><b k='v'>t</b></a>"), ("b.xml", "<a>")], "uri string, text string"), "xml").results.collect()
    assert {r["uri"]: (r["errors"], r["n_chunks"]) for r in xml} == {"a.xml": ([], 1), "b.xml": (["E_SECURITY_INVALID_XML"], 0)}
    html = chains.process(spark.createDataFrame([("a.html", "<p>one</p><script>x</script><p>two</p>")], "uri string, text string"), "html")
    assert html.results.first()["n_chunks"] == 1 and "x" not in html.chunks.first()["chunk"]


def test_nearest_of_few_queries(spark):
    import numpy as np

    r = np.random.default_rng(1)
    vectors = r.normal(size=(700, 6))
    vectors[5] = vectors[9] * 2
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    queries = frame.filter("vec_id < 12").selectExpr("vec_id as query_id", "embedding as query")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {}
    for x in retrieval.top_k(frame, queries, 4).collect():
        found.setdefault(x["query_id"], {})[x["rank"]] = x["vec_id"]
    for q, got in found.items():
        assert [got[k] for k in (1, 2, 3, 4)] == sorted(range(700), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:4]
    assert retrieval.top_k(frame, queries.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="batches"):
        retrieval.top_k(frame, queries, 4, most_queries=3)
