"""Queries of the form operators: orders are forms, line items their fields, parts and suppliers the templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import ids, text
from docloom.operators import forms
from docloom.plans.registry import query, table

FIELDS = """f AS (SELECT l_orderkey AS doc, l_suppkey % 10 AS template, 'f' || l_partkey % 6 AS field, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place,
  round(l_discount * 9 + l_tax, 4) AS confidence, l_partkey % 3 = 0 AS required, l_linenumber % 4 AS page, l_returnflag AS value FROM lineitem)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 10).alias("template"), F.expr("'f' || l_partkey % 6").alias("field"), place.alias("place"), F.round(F.col("l_discount") * 9 + F.col("l_tax"), 4).alias("confidence"),
        (F.col("l_partkey") % 3 == 0).alias("required"), (F.col("l_linenumber") % 4).alias("page"), F.col("l_returnflag").alias("value"),
    )


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'image' WHEN 3 THEN 'image' END AS format FROM documents")
def s4_form_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("'form.' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.tif' ELSE '.txt' END")
    return table(spark, sf_dir, "documents").select("doc_id", forms.source_format(path).alias("format"))


GRID = """g AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.05 THEN 0 WHEN abs(x) < 0.25 THEN 1 WHEN abs(x) < 0.6 THEN 2 ELSE 3 END) AS grid FROM embeddings),
  d AS (SELECT vec_id // 3 AS doc, vec_id % 3 AS page, CASE WHEN vec_id // 3 % 2 = 0 THEN 'pdf' ELSE 'image' END AS format, grid FROM g),
  t AS (SELECT doc AS template, 1 AS version, page, format, grid FROM d WHERE doc % 25 < 2 AND page < 2),
  sim AS (SELECT d.doc, t.template, t.version, d.page - t.page AS start, list_sum(list_transform(list_zip(d.grid, t.grid), lambda z: CASE WHEN z[1] = z[2] THEN 1.0 WHEN abs(z[1] - z[2]) = 1 THEN 0.5 ELSE 0.0 END))::DOUBLE / len(d.grid) AS s,
    dn.n AS d_n, tn.n AS t_n FROM d JOIN t USING (format) JOIN (SELECT doc, count(*) AS n FROM d GROUP BY 1) dn ON dn.doc = d.doc JOIN (SELECT template, count(*) AS n FROM t GROUP BY 1) tn ON tn.template = t.template
    WHERE dn.n >= tn.n AND d.page >= t.page AND d.page - t.page <= dn.n - tn.n),
  run AS (SELECT doc, template, version, start, min(s) AS least, avg(s) - any_value(d_n - t_n) * 0.02 AS confidence, count(*) AS n, any_value(t_n) AS t_n FROM sim GROUP BY ALL),
  m AS (SELECT * FROM run WHERE least >= 0.6 AND n = t_n QUALIFY row_number() OVER (PARTITION BY doc, template, version ORDER BY round(confidence, 9) DESC, start) = 1)"""


def grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: text.fill_level(F.abs(x))).alias("grid"))
    d = g.select(F.expr("vec_id div 3 AS doc"), F.expr("vec_id % 3 AS page"), F.expr("CASE WHEN vec_id div 3 % 2 = 0 THEN 'pdf' ELSE 'image' END AS format"), "grid")
    # Every vector is a document's page; the first two pages of some documents are the templates.
    t = d.filter("doc % 25 < 2 and page < 2")
    return d, t.select(F.col("doc").alias("template"), F.lit(1).alias("version"), "page", "format", "grid")


@query(f"WITH {GRID} SELECT doc, template, start, round(confidence, 6) AS confidence FROM m")
def j1_j2_a12_match_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.match_pages(*grids(spark, sf_dir)).select("doc", "template", "start", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {GRID}, r AS (SELECT doc, template, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY doc ORDER BY round(confidence, 6) DESC, template) AS match_rank FROM m WHERE round(confidence, 6) >= 0.65)
  SELECT doc, template, confidence, match_rank::INTEGER AS match_rank, match_rank = 1 AND confidence >= 0.75 AS accepted FROM r""")
def l1_g9_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.match_pages(*grids(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
    return forms.top_matches(found, 0.65, 0.75).select("doc", "template", "confidence", "match_rank", "accepted")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_discount < 0.05 THEN 0 WHEN l_discount < 0.25 THEN 1 WHEN l_discount < 0.6 THEN 2 ELSE 3 END AS level FROM lineitem")
def f16_a13_fill_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.fill_level(F.col("l_discount")).alias("level"))


@query("""WITH px AS (SELECT l_orderkey % 50 AS doc, 0 AS page, l_partkey % 400 AS x, l_suppkey * 7 % 320 AS y, (l_returnflag = 'R')::INT AS dark FROM lineitem),
  c AS (SELECT doc, page, least(y * 16 // 320, 15) AS cy, least(x * 20 // 400, 19) AS cx, avg(dark) AS ratio FROM px GROUP BY ALL)
  SELECT doc, cy::INTEGER AS cy, cx::INTEGER AS cx, round(ratio, 9) AS ratio, CASE WHEN ratio < 0.05 THEN 0 WHEN ratio < 0.25 THEN 1 WHEN ratio < 0.6 THEN 2 ELSE 3 END AS level FROM c""")
def a13_a14_fill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey % 50 AS doc"), F.lit(0).alias("page"), F.expr("l_partkey % 400 AS x"), F.expr("l_suppkey * 7 % 320 AS y"), (F.col("l_returnflag") == "R").cast("int").alias("dark"))
    return forms.fill_grid(pixels, 20, 16, 400, 320).select("doc", "cy", "cx", F.round("ratio", 9).alias("ratio"), "level")


@query("SELECT vec_id, list_transform(range(1, 17), lambda i: (('0x' || substr(md5(vec_id::VARCHAR), 2 * i - 1, 2))::INTEGER)) AS grid FROM embeddings")
def f17_fingerprint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", forms.unpack_grid(F.unhex(F.md5(F.col("vec_id").cast("string")))).alias("grid"))


BOXES = """w AS (SELECT doc, page, place, value, place * 0.05 AS x, 0.1 * page AS y, 0.2 AS w, 0.08 AS h FROM f), k AS (SELECT DISTINCT doc, page, field, 0.05 * (field[2]::INT) + 0.03 AS x, 0.1 * page + 0.01 AS y, 0.2 AS w, 0.08 AS h FROM f),
  o AS (SELECT k.doc, k.page, field, place, value, greatest(0, least(k.x + k.w, w.x + w.w) - greatest(k.x, w.x)) * greatest(0, least(k.y + k.h, w.y + w.h) - greatest(k.y, w.y)) AS shared FROM k JOIN w USING (doc, page)),
  i AS (SELECT *, shared / (2 * 0.2 * 0.08 - shared) AS iou FROM o)"""


@query(f"WITH {FIELDS}, {BOXES} SELECT doc, page, field, place::INTEGER AS place, value, round(iou::DOUBLE, 6) AS iou FROM i WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc, page, field ORDER BY round(iou, 9) DESC, place) = 1")
def j3_f11_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).withColumn("doc", F.concat_ws("/", "doc", "page"))
    at = lambda frame, x, y: frame.withColumn("x", x).withColumn("y", y).withColumn("w", F.lit(0.2)).withColumn("h", F.lit(0.08))
    widgets = at(f.select("doc", "page", "place", "value"), F.col("place") * 0.05, F.col("page") * 0.1)
    wanted = at(f.select("doc", "page", "field").distinct(), F.substring("field", 2, 1).cast("int") * 0.05 + 0.03, F.col("page") * 0.1 + 0.01)
    found = forms.fields_from_widgets(wanted, widgets)
    return found.select(F.substring_index("doc", "/", 1).cast("long").alias("doc"), "page", "field", "place", "value", F.round("iou", 6).alias("iou"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, greatest(0, least(1700, floor(l_discount * 5 * 1700)))::INTEGER AS "left", greatest(0, least(2200, floor((l_tax * 9 + 0.3) * 2200)))::INTEGER AS bottom FROM lineitem""")
def f12_box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = text.box_pixels(F.col("l_discount") * 5, F.col("l_tax") * 9, F.lit(0.1), F.lit(0.3), 1700, 2200)
    return table(spark, sf_dir, "lineitem").withColumn("b", box).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "b.left", "b.bottom")


@query(f"""WITH {FIELDS}, h AS (SELECT *, greatest(0.9, least(0.99, confidence + 0.5)) AS held FROM f)
  SELECT doc, place::INTEGER AS place, round(CASE WHEN place % 4 = 0 THEN least(confidence + 0.5, 1.0) WHEN required THEN greatest(0.9, held - 0.02) ELSE held END, 9)::DOUBLE AS native, round(least(abs(confidence - 0.3) / 0.3, 1.0), 9)::DOUBLE AS mark,
  CASE WHEN confidence >= 0.5 THEN 'accept' WHEN confidence >= 0.4 THEN 'warn' WHEN required THEN 'vlm' ELSE 'null' END AS action FROM h""")
def f8_f10_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, required = F.col("confidence"), F.col("required")
    native = text.field_confidence(c + 0.5, required, F.col("place") % 4 != 0)
    return fields(spark, sf_dir).select("doc", "place", F.round(native, 9).alias("native"), F.round(text.mark_confidence(c, 0.3), 9).alias("mark"), text.confidence_action(c, required).alias("action"))


@query(f"""WITH {FIELDS}, tf AS (SELECT DISTINCT template, 'f' || template % 6 AS field, template % 2 = 0 AS required FROM f), j AS (SELECT doc, confidence, CASE WHEN required THEN 2.0 ELSE 1.0 END AS weight FROM (SELECT f.doc, f.confidence, tf.required FROM f LEFT JOIN tf USING (template, field)))
  SELECT doc, round((sum(confidence * weight) / greatest(sum(weight), 1))::DOUBLE, 6) AS confidence FROM j GROUP BY doc""")
def j4_a10_overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    known = f.select("template").distinct().select("template", F.expr("'f' || template % 6 AS field"), F.expr("template % 2 = 0 AS required"))
    return forms.overall_confidence(f, known).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {FIELDS} SELECT doc, place::INTEGER AS place, r::INTEGER AS budget_rank, r <= 2 AS in_budget FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY required DESC, confidence, place) AS r FROM f WHERE confidence < 0.4)""")
def w16_vlm_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.vlm_candidates(fields(spark, sf_dir), budget=2).select("doc", "place", "budget_rank", "in_budget")


@query(f"""WITH {FIELDS}, v AS (SELECT doc, field, min(value) || '!' AS vlm_value, max(confidence) AS vlm_confidence FROM f WHERE place % 2 = 0 GROUP BY ALL)
  SELECT doc, place::INTEGER AS place, CASE WHEN vlm_confidence >= 0.5 THEN vlm_value ELSE value END AS value, CASE WHEN vlm_confidence >= 0.5 THEN vlm_confidence ELSE confidence END AS confidence, CASE WHEN vlm_confidence >= 0.5 THEN 'vlm' ELSE 'native' END AS method FROM f LEFT JOIN v USING (doc, field)""")
def j14_vlm_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    readings = f.filter("place % 2 = 0").groupBy("doc", "field").agg(F.concat(F.min("value"), F.lit("!")).alias("vlm_value"), F.max("confidence").alias("vlm_confidence"))
    return forms.with_vlm(f, readings).select("doc", "place", "value", "confidence", "method")


VERSIONS = """v AS (SELECT o_custkey AS template, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status,
    'T' || o_custkey AS name, md5(o_orderpriority) AS fingerprint, CASE WHEN o_custkey % 2 = 0 THEN 'pdf' ELSE 'image' END AS format FROM orders),
  x AS (SELECT template, version FROM v WHERE (template + version) % 3 = 0 UNION ALL SELECT DISTINCT template, NULL::INTEGER FROM v WHERE template % 13 = 0),
  live AS (SELECT * FROM v WHERE template NOT IN (SELECT template FROM x WHERE version IS NULL) AND (template, version) NOT IN (SELECT (template, version) FROM x WHERE version IS NOT NULL)),
  cur AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY template ORDER BY version DESC) = 1)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    v = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("template"), number.alias("version"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status"), F.expr("'T' || o_custkey AS name"),
        F.md5("o_orderpriority").alias("fingerprint"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN 'pdf' ELSE 'image' END AS format"),
    )
    gone = v.filter("(template + version) % 3 = 0").select("template", "version").unionByName(v.filter("template % 13 = 0").select("template", F.lit(None).cast("int").alias("version")).distinct())
    return v, gone


@query(f"WITH {VERSIONS} SELECT template, version, status, name FROM cur")
def w15_s17_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.latest_versions(*versions(spark, sf_dir)).select("template", "version", "status", "name")


@query(f"WITH {VERSIONS} SELECT template, version, status FROM live WHERE status = 'approved'")
def j15_l2_live_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.live_versions(*versions(spark, sf_dir)).filter("status = 'approved'").select("template", "version", "status").orderBy("template", F.desc("version"))


@query(f"""WITH {VERSIONS}, q AS (SELECT c_custkey AS request, c_custkey AS template, CASE WHEN c_custkey % 4 = 0 THEN 2 END AS version, CASE WHEN c_custkey % 5 = 0 THEN 'xlsx' WHEN c_custkey % 2 = 0 THEN 'pdf' ELSE 'image' END AS format FROM customer),
  w AS (SELECT q.*, coalesce(q.version, cur.version) AS want FROM q LEFT JOIN cur USING (template))
  SELECT request, w.template, live.version AS found, CASE WHEN live.version IS NULL THEN 'E_FORM_TEMPLATE_NOT_FOUND' WHEN live.format <> w.format THEN 'E_FORM_FORMAT_MISMATCH' END AS error FROM w LEFT JOIN live ON live.template = w.template AND live.version = w.want""")
def j13_resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.col("c_custkey").alias("template"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 2 END AS version"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'xlsx' WHEN c_custkey % 2 = 0 THEN 'pdf' ELSE 'image' END AS format"))
    return forms.resolve_requests(requests, *versions(spark, sf_dir))


@query(f"""WITH {VERSIONS}, ch AS (SELECT template, 'N' || template AS name, CASE WHEN template % 2 = 0 THEN md5('new') END AS fingerprint FROM cur WHERE template % 3 = 0)
  SELECT template, version + 1 AS version, CASE WHEN ch.fingerprint IS NOT NULL THEN 'draft' ELSE status END AS status, ch.name, coalesce(ch.fingerprint, cur.fingerprint) AS fingerprint FROM cur JOIN ch USING (template)""")
def g2_update_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = forms.latest_versions(*versions(spark, sf_dir))
    changes = current.filter("template % 3 = 0").select("template", F.expr("'N' || template AS name"), F.when(F.col("template") % 2 == 0, F.md5(F.lit("new"))).alias("fingerprint"))
    return forms.updated_version(current, changes)


@query(f"WITH {VERSIONS} SELECT template, version + 1 AS version, 'approved' AS status FROM cur WHERE status = 'draft' AND template % 2 = 1 UNION ALL SELECT template, version + 1, 'archived' FROM cur WHERE template % 2 = 0")
def g3_g4_approve_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = forms.latest_versions(*versions(spark, sf_dir))
    kept, (gone, _) = forms.approved(current, current.filter("template % 2 = 1")), forms.archived(current, current.filter("template % 2 = 0"))
    return kept.unionByName(gone).select("template", "version", "status")


@query("SELECT o_orderkey, sha256(md5(o_orderkey::VARCHAR) || '|T' || o_custkey || '|3') AS extraction_key FROM orders")
def g7_extraction_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.extraction_key(F.md5(F.col("o_orderkey").cast("string")), F.expr("'T' || o_custkey"), F.lit(3)).alias("extraction_key"))


TEXT = """gr AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc) <= 4 THEN 0 ELSE page END AS "group" FROM f)"""


@query(f"""WITH {FIELDS}, {TEXT} SELECT doc, "group", 'Form: order (v2)' || chr(10) || 'Date Extracted: 2026-01-02' || chr(10) || chr(10) || string_agg(field || ': ' || CASE WHEN place % 5 = 0 THEN CASE WHEN required THEN 'Yes' ELSE 'No' END WHEN place % 7 = 3 THEN '[not extracted]' ELSE value END, chr(10) ORDER BY place) AS text FROM gr GROUP BY ALL""")
def t11_t12_form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = forms.field_groups(fields(spark, sf_dir), 4)
    shown = grouped.select("doc", F.lit("order").alias("form"), F.lit(2).alias("version"), "group", "place", F.col("field").alias("label"), F.when(F.col("place") % 7 != 3, F.col("value")).alias("value"), F.when(F.col("place") % 5 == 0, F.col("required")).alias("flag"))
    return forms.form_texts(shown, "2026-01-02")


@query(f"""WITH {FIELDS} SELECT doc, place::INTEGER AS place, CASE WHEN page % 3 = 0 THEN regexp_replace(value || ' 1,2-3.4 x', '[^0-9.\\-,]', '', 'g') WHEN page % 3 = 1 THEN trim(regexp_replace(value, '\\s+', ' ', 'g')) || ' b' ELSE trim(value) || '  b' END AS value FROM f""")
def f3_ocr_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("page") % 3 == 0, F.concat("value", F.lit(" 1,2-3.4 x"))).otherwise(F.concat(F.lit(" "), "value", F.lit("  b ")))
    return fields(spark, sf_dir).select("doc", "place", text.ocr_value(raw, F.when(F.col("page") % 3 == 0, "number").when(F.col("page") % 3 == 1, "date").otherwise("text")).alias("value"))


@query(f"""WITH {FIELDS}, s AS (SELECT f.*, avg(confidence) OVER (PARTITION BY doc) AS overall FROM f) SELECT doc, place::INTEGER AS place, CASE WHEN round(overall, 6) >= 0.45 THEN value END AS value FROM s""")
def g10_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    overall = f.groupBy("doc").agg(F.round(F.avg("confidence"), 6).alias("confidence"))
    return forms.fail_closed(f, overall, 0.45).select("doc", "place", "value")


@query(f"""WITH {FIELDS} SELECT doc, field, coalesce(string_agg(v, chr(10) ORDER BY page, place) FILTER (v <> ''), '') AS value FROM (SELECT *, trim(CASE WHEN place % 3 = 0 THEN ' ' ELSE value || place END) AS v FROM f) GROUP BY doc, field""")
def f6_range_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fields(spark, sf_dir).select("doc", "field", F.col("page").alias("row"), F.col("place").alias("col"), F.when(F.col("place") % 3 == 0, " ").otherwise(F.concat("value", F.col("place").cast("string"))).alias("value"))
    return forms.range_value(cells)


@query(f"""WITH {FIELDS} SELECT doc, place::INTEGER AS place, CASE WHEN place % 4 <> 0 THEN value WHEN NOT required THEN 'none' END AS value, CASE WHEN place % 4 = 0 AND required THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence,
  CASE WHEN place % 4 = 0 AND required THEN 'W_FORM_FIELD_MISSING_REQUIRED' END AS warning, CASE WHEN place % 3 = 0 THEN CASE WHEN value = 'R' THEN '1' ELSE '0' END ELSE value END AS stored,
  round(CASE WHEN place % 5 = 0 THEN confidence ELSE (confidence + 0.5) / 2 END, 9)::DOUBLE AS mean FROM f""")
def f7_f19_a11_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = fields(spark, sf_dir), F.col("confidence")
    cell = forms.cell_value(F.when(F.col("place") % 4 != 0, F.col("value")).otherwise(" "), F.col("required"), F.lit("none"))
    flag = F.when(F.col("place") % 3 == 0, F.when(F.col("value") == "R", "true").otherwise("false")).otherwise(F.col("value"))
    stored = forms.stored_value(flag, F.when(F.col("place") % 3 == 0, "checkbox").otherwise("text"))
    mean = forms.character_confidence(F.when(F.col("place") % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(c, F.lit(0.5))), c)
    return f.select("doc", "place", cell["value"].alias("value"), cell["confidence"].alias("confidence"), cell["warning"].alias("warning"), stored.alias("stored"), F.round(mean, 9).alias("mean"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'cell_mapping' WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 <> 0 THEN 'native_fields' END WHEN doc_id % 5 IN (0, 2, 3) AND doc_id % 11 <> 0 THEN 'ocr_overlay' END AS method,
  CASE WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'E_FORM_NATIVE_FIELDS_UNAVAILABLE' END WHEN doc_id % 5 IN (0, 2, 3) THEN CASE WHEN doc_id % 11 = 0 THEN 'E_FORM_OCR_FAILED' END ELSE 'E_FORM_UNSUPPORTED_FORMAT' END AS error FROM documents""")
def g8_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("'form.' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.tif' ELSE '.txt' END")
    n = F.col("doc_id")
    chosen = forms.choose_extractor(forms.source_format(path), n % 3 == 0, n % 7 != 0, n % 11 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", chosen.alias("c")).select("doc_id", "c.method", "c.error")


@query("""SELECT c_custkey AS template, c_name AS name, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE 1 END::INTEGER AS version, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'E_FORM_TEMPLATE_INVALID' END AS error FROM customer""")
def g1_create_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    requests = c.select(F.col("c_custkey").alias("template"), F.col("c_name").alias("name"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'live' WHEN c_custkey % 2 = 0 THEN 'approved' END AS status"), F.lit("pdf").alias("format"), F.lit(None).cast("binary").alias("fingerprint"))
    patterns = c.select(F.col("c_custkey").alias("template"), F.lit("f").alias("field"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN '[a-' WHEN c_custkey % 3 = 0 THEN '[a-z]+' END AS pattern"))
    made, refused = forms.created_templates(requests, patterns)
    return made.select("template", "name", "version", F.lit(None).cast("string").alias("error")).unionByName(refused.select("template", "name", F.lit(None).cast("int").alias("version"), "error"))
