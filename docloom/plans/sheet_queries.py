"""Queries of the spreadsheet operators. Each order is a file whose sheet has its line items as rows; documents serve as text sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import sheets
from docloom.plans.registry import query, table

ROWS = """r AS (SELECT l_orderkey AS file, 'items' AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row, * FROM lineitem)"""
CELLS = (
    ROWS
    + """, cell AS (
  SELECT file, sheet, row, 1 AS col, l_quantity AS num, NULL AS str FROM r UNION ALL SELECT file, sheet, row, 2, NULL, l_returnflag FROM r
  UNION ALL SELECT file, sheet, row, 3, CASE WHEN l_discount > 0 THEN l_discount END, NULL FROM r UNION ALL SELECT file, sheet, row, 4, CASE WHEN l_tax < 0.03 THEN l_tax END, CASE WHEN l_tax >= 0.03 THEN 'high' END FROM r
  UNION ALL SELECT file, sheet, row, 5, NULL, CASE WHEN l_linestatus = 'O' THEN l_linestatus ELSE ' ' END FROM r),
  c AS (SELECT *, CASE WHEN num IS NOT NULL THEN 'numeric' WHEN coalesce(trim(str), '') <> '' THEN 'text' ELSE 'empty' END AS class FROM cell)"""
)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").withColumn("file", F.col("l_orderkey")).withColumn("sheet", F.lit("items")).withColumn("row", n)


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item with its five cells."""
    none = {"num": F.lit(None).cast("double"), "str": F.lit(None).cast("string")}
    tax = {"num": F.when(F.col("l_tax") < 0.03, F.col("l_tax")), "str": F.when(F.col("l_tax") >= 0.03, "high")}
    parts = [{"num": F.col("l_quantity").cast("double")}, {"str": F.col("l_returnflag")}, {"num": F.when(F.col("l_discount") > 0, F.col("l_discount"))}, tax, {"str": F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).otherwise(" ")}]
    packed = F.array(*(F.struct(F.lit(i).alias("col"), *(c.alias(k) for k, c in (none | part).items())) for i, part in enumerate(parts, 1)))
    return rows(spark, sf_dir).select("file", "sheet", "row", packed.alias("cells"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.unpacked(cell_rows(spark, sf_dir))


# A sheet per document: words of a line are its cells. Three empty rows follow every four lines, three empty columns the twelfth word.
GRID = """g0 AS (SELECT doc_id AS file, 'text' AS sheet, row + 3 * ((row - 1) // 4) AS row, col + CASE WHEN col > 12 THEN 3 ELSE 0 END AS col, w
  FROM (SELECT doc_id, row, unnest(range(1, len(w) + 1)) AS col, unnest(w) AS w FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS row, string_split(unnest(l), ' ') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))),
  g AS (SELECT file, sheet, row, col, CASE WHEN row % 3 = 0 AND col % 2 = 0 THEN length(w)::DOUBLE END AS num, CASE WHEN row % 3 = 0 AND col % 2 = 0 THEN NULL ELSE w END AS str FROM g0),
  c AS (SELECT *, CASE WHEN num IS NOT NULL THEN 'numeric' WHEN coalesce(trim(str), '') <> '' THEN 'text' ELSE 'empty' END AS class FROM g)"""


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line of a document with its words as cells."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit("text").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.select("file", "sheet", F.expr("line_no + 1 + 3 * (line_no div 4)").cast("int").alias("row"), F.split("line", " ").alias("words"))
    col = lambda at: at + F.when(at < 12, 1).otherwise(4)
    number = lambda at: (F.col("row") % 3 == 0) & (col(at) % 2 == 0)
    # Arrays of plain values, zipped: structs made by a lambda take three times as long.
    fields = {"col": lambda w, at: col(at), "num": lambda w, at: F.when(number(at), F.length(w).cast("double")), "str": lambda w, at: F.when(~number(at), w)}
    return rows.select("file", "sheet", "row", F.arrays_zip(*(F.transform("words", of).alias(name) for name, of in fields.items())).alias("cells"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.unpacked(grid_rows(spark, sf_dir))


HEADERS = "hd AS (SELECT DISTINCT file, sheet, file % 3 AS header_row FROM c)"


@query(f"""WITH {CELLS}, {HEADERS} SELECT file, sheet, round(count_if(class = 'numeric') / count(*), 9) AS numeric_ratio, round(count_if(class = 'text') / count(*), 9) AS text_ratio, round(count_if(class = 'empty') / count(*), 9) AS empty_ratio
  FROM c JOIN hd USING (file, sheet) WHERE row > header_row GROUP BY ALL""")
def a1_type_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    headers = c.select("file", "sheet", (F.col("file") % 3).alias("header_row")).distinct()
    found = sheets.type_ratios(c, headers)
    return found.select("file", "sheet", *(F.round(c, 9).alias(c) for c in ("numeric_ratio", "text_ratio", "empty_ratio")))


CONSISTENCY = "n AS (SELECT file, sheet, col, class, count(*) AS n FROM c WHERE class <> 'empty' GROUP BY ALL), t AS (SELECT file, sheet, col, max(n) AS top, sum(n) AS total FROM n GROUP BY ALL)"


@query(f"WITH {CELLS}, {CONSISTENCY} SELECT file, sheet, round(sum(top) / sum(total), 9)::DOUBLE AS consistency FROM t GROUP BY ALL")
def a2_column_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.column_consistency(cells(spark, sf_dir)).select("file", "sheet", F.round("consistency", 9).alias("consistency"))


@query(f"WITH {GRID} SELECT file, sheet, min(row)::INTEGER AS row_0, max(row)::INTEGER AS row_1, min(col)::INTEGER AS col_0, max(col)::INTEGER AS col_1 FROM c WHERE class <> 'empty' GROUP BY ALL")
def a3_data_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.data_bounds(grid(spark, sf_dir))


PROFILE = f"""{CONSISTENCY}, p AS (
  SELECT file, sheet, n_rows, merged_ratio, consistency, header_row, numeric_ratio FROM
  (SELECT file, sheet, count(DISTINCT row) AS n_rows, count_if(class = 'numeric') / count(*) AS numeric_ratio, (file % 4) / 20.0 AS merged_ratio, CASE WHEN file % 3 = 0 THEN 1 ELSE 0 END AS header_row FROM c GROUP BY ALL) JOIN
  (SELECT file, sheet, sum(top) / sum(total) AS consistency FROM t GROUP BY ALL) USING (file, sheet)),
  v AS (SELECT *, (n_rows >= 5)::INT + (merged_ratio < 0.05)::INT + (consistency >= 0.7)::INT + (header_row > 0)::INT + (numeric_ratio >= 0.3)::INT AS signals FROM p),
  s AS (SELECT *, CASE WHEN signals >= 3 THEN 'tabular_data' ELSE 'formatted_document' END AS sheet_type, CASE WHEN signals IN (0, 1, 4, 5) THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM v)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = sheets.sheet_profile(cell_rows(spark, sf_dir))
    profile = profile.withColumn("merged_ratio", F.col("file") % 4 / 20).withColumn("header_row", F.when(F.col("file") % 3 == 0, 1).otherwise(0))
    return sheets.sheet_vote(profile)


@query(f"WITH {CELLS}, {PROFILE} SELECT file, sheet, signals, sheet_type, confidence FROM s")
def c1_sheet_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).select("file", "sheet", "signals", "sheet_type", "confidence")


@query(f"""WITH {CELLS}, {PROFILE}, f AS (SELECT file // 3 AS file, sheet_type, confidence FROM s)
  SELECT file::BIGINT AS file, CASE WHEN count(DISTINCT sheet_type) = 1 THEN min(sheet_type) ELSE 'hybrid' END AS file_type, CASE WHEN count(DISTINCT sheet_type) = 1 THEN min(confidence) ELSE 0.9 END::DOUBLE AS confidence FROM f GROUP BY file""")
def c2_file_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.file_vote(votes(spark, sf_dir).withColumn("file", F.floor(F.col("file") / 3)))


@query(f"WITH {CELLS} SELECT file // 3 AS file, count(DISTINCT file)::BIGINT AS n_sheets, count(DISTINCT (file, row))::BIGINT AS n_rows, count_if(class = 'empty')::BIGINT AS empty_cells FROM c GROUP BY 1")
def a4_file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = cells(spark, sf_dir).withColumn("sheet", F.col("file").cast("string")).withColumn("file", F.floor(F.col("file") / 3))
    return sheets.file_rollup(books)


HEADER = """h AS (SELECT file, sheet, row, count_if(class = 'text') AS texts, count_if(class = 'numeric') AS numbers, min(CASE WHEN class <> 'empty' THEN col END) AS a, max(CASE WHEN class <> 'empty' THEN col END) AS b FROM c WHERE row <= 20 GROUP BY ALL)"""


@query(f"WITH {GRID}, {HEADER} SELECT file, sheet, coalesce(min(CASE WHEN texts >= 2 AND numbers = 0 AND texts / (b - a + 1) >= 0.5 THEN row END), 0)::INTEGER AS header_row FROM h GROUP BY ALL")
def w1_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.header_rows(grid(spark, sf_dir))


@query(f"""WITH {ROWS}, t AS (SELECT file, row, CASE WHEN row % 4 IN (0, 3) THEN 'Grand  Total' ELSE l_returnflag END AS label FROM r), last AS (SELECT file, max(row) AS last FROM t WHERE NOT regexp_matches(lower(label), '^(total|sum|grand\\s*total|subtotal)$') GROUP BY file)
  SELECT file, row::INTEGER AS row, label FROM t JOIN last USING (file) WHERE row <= last""")
def w2_totals_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("row").cast("int") % 4 >= 3, "Grand  Total").when(F.col("row") % 4 == 0, "Grand  Total").otherwise(F.col("l_returnflag"))
    c = rows(spark, sf_dir).select("file", "sheet", "row", F.lit(1).alias("col"), F.lit(None).cast("double").alias("num"), label.alias("str"))
    return sheets.without_totals(c).select("file", "row", F.col("str").alias("label"))


SECTION_ROWS = """l AS (SELECT doc_id AS file, unnest(range(1, len(x) + 1)) AS row, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  m AS (SELECT *, (row % 5 = 0) AS is_blank, (row % 7 = 1) AS is_title FROM l), n AS (SELECT *, sum((is_blank OR is_title)::INT) OVER w AS part, last_value(CASE WHEN is_title THEN substr(line, 1, 20) END IGNORE NULLS) OVER w AS title FROM m WINDOW w AS (PARTITION BY file ORDER BY row))"""


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit("text").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    lines = lines.withColumn("row", F.col("row") + 1)
    return lines.withColumn("is_blank", F.col("row") % 5 == 0).withColumn("is_title", F.col("row") % 7 == 1).withColumn("title", F.substring("line", 1, 20))


@query(f"WITH {SECTION_ROWS} SELECT file, row::INTEGER AS row, dense_rank() OVER (PARTITION BY file ORDER BY part)::INTEGER AS section, title AS section_title FROM n WHERE NOT is_blank AND NOT is_title")
def w3_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sections(section_rows(spark, sf_dir)).select("file", "row", "section", "section_title")


def _gap_sql(axis: str) -> str:
    return f"""WITH {GRID}, f AS (SELECT file, sheet, {axis}, lag({axis}) OVER (PARTITION BY file, sheet ORDER BY {axis}) AS before FROM (SELECT DISTINCT file, sheet, {axis} FROM c WHERE class <> 'empty'))
  SELECT file, sheet, (before + 1)::INTEGER AS start, ({axis} - before - 1)::INTEGER AS length FROM f WHERE {axis} - before > 2"""


@query(_gap_sql("row"))
def w4_row_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.row_gaps(grid(spark, sf_dir))


@query(_gap_sql("col"))
def w5_column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.row_gaps(grid(spark, sf_dir), "col")


TRANSITIONS = """q AS (SELECT file, sheet, row, count_if(class = 'numeric') AS n, count_if(class <> 'empty') AS total FROM c GROUP BY ALL),
  s AS (SELECT file, sheet, row, sum(n) OVER a / nullif(sum(total) OVER a, 0) AS above, sum(n) OVER b / nullif(sum(total) OVER b, 0) AS below FROM q
  WINDOW a AS (PARTITION BY file, sheet ORDER BY row ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), b AS (PARTITION BY file, sheet ORDER BY row ROWS BETWEEN CURRENT ROW AND {j} FOLLOWING)),
  tr AS (SELECT file, sheet, row FROM s WHERE (above >= {h} AND below <= 1 - {h} + 1e-12) OR (above <= 1 - {h} + 1e-12 AND below >= {h}))"""


@query(f"WITH {CELLS}, {TRANSITIONS.format(k=1, j=0, h=0.55)} SELECT file, row::INTEGER AS row FROM tr")
def w6_format_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.format_transitions(cells(spark, sf_dir), 1, 0.55).select("file", "row")


REGIONS = f"""{GRID}, gap AS (SELECT file, sheet, before + 1 AS row FROM (SELECT file, sheet, row, lag(row) OVER (PARTITION BY file, sheet ORDER BY row) AS before FROM (SELECT DISTINCT file, sheet, row FROM c WHERE class <> 'empty')) WHERE row - before > 2),
  {TRANSITIONS.format(k=1, j=0, h=0.6)}, cut AS (SELECT file, sheet, row FROM gap UNION SELECT file, sheet, row FROM tr),
  part AS (SELECT file, sheet, row, col, (SELECT count(*) FROM cut WHERE cut.file = c.file AND cut.sheet = c.sheet AND cut.row <= c.row) AS part FROM c WHERE class <> 'empty'),
  box AS (SELECT file, sheet, part, min(row) AS row_0, max(row) + 1 AS row_1, min(col) AS col_0, max(col) + 1 AS col_1 FROM part GROUP BY ALL)"""


@query(f"WITH {REGIONS} SELECT file, sheet, row_number() OVER (PARTITION BY file, sheet ORDER BY part)::INTEGER AS region, row_0::INTEGER AS row_0, row_1::INTEGER AS row_1, col_0::INTEGER AS col_0, col_1::INTEGER AS col_1 FROM box")
def w7_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.regions(sheets.region_rows(grid_rows(spark, sf_dir), 1)).select("file", "sheet", "region", "row_0", "row_1", "col_0", "col_1")


@query(f"WITH {REGIONS} SELECT DISTINCT file, sheet, row::INTEGER AS row FROM cut")
def u1_boundary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.boundaries(grid_rows(spark, sf_dir), 1)


@query(f"""WITH {REGIONS}, num AS (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY part) AS region FROM box),
  k AS (SELECT c.file, c.sheet, region, col, count(DISTINCT class) AS kinds FROM c JOIN num ON c.file = num.file AND c.sheet = num.sheet AND row >= row_0 AND row < row_1 AND col >= col_0 AND col < col_1 WHERE class <> 'empty' GROUP BY ALL)
  SELECT file, sheet, region::INTEGER AS region, round(count_if(kinds = 1) / count(*), 9) AS single_type_share FROM k GROUP BY ALL""")
def c12_region_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As the SQL's join by file, this leaves out cells without one.
    found = sheets.single_type_share(sheets.region_rows(grid_rows(spark, sf_dir).filter("file is not null"), 1))
    return found.select("file", "sheet", "region", F.round("single_type_share", 9).alias("single_type_share"))


@query(f"""WITH {ROWS}, k AS (SELECT file, count(*) AS n, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_tax = 0) AS corner FROM r GROUP BY file)
  SELECT file, CASE WHEN has_r THEN 'checklist' WHEN corner AND n >= 2 THEN 'matrix' WHEN n >= 2 THEN 'table' ELSE 'free_text' END AS structure FROM k""")
def c11_section_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = rows(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("l_returnflag") == "R", "task status").otherwise("item")).alias("header"), F.max(F.col("l_tax") == 0).alias("corner"))
    return k.select("file", sheets.section_structure(F.col("header"), F.col("n"), F.col("corner"), F.lit(True)).alias("structure"))


@query(f"WITH {ROWS}, m AS (SELECT file, row, (row - 1) // 3 AS block, l_quantity FROM r) SELECT file, row::INTEGER AS row, first_value(l_quantity) OVER (PARTITION BY file, block ORDER BY row) AS num FROM m")
def j12_merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir)
    c = base.select("file", "sheet", "row", F.lit(1).alias("col"), F.col("l_quantity").alias("num"), F.lit(None).cast("string").alias("str"))
    last = c.groupBy("file", "sheet").agg(F.max("row").alias("n"))
    tops = last.select("file", "sheet", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(3))).alias("row_0"), "n")
    merges = tops.select("file", "sheet", "row_0", F.least(F.col("row_0") + 2, "n").alias("row_1"), F.lit(1).alias("col_0"), F.lit(1).alias("col_1"))
    return sheets.merged_values(c, merges).select("file", "row", "num")


@query("""SELECT 'p_name' AS column_name, count(DISTINCT p_name) || ' unique values' AS description FROM part HAVING count(DISTINCT p_name) >= 20
  UNION ALL SELECT 'p_name', 'one of ' || string_agg(p_name, ', ' ORDER BY f) FROM (SELECT p_name, min(p_partkey) AS f FROM part GROUP BY 1) HAVING count(*) < 20
  UNION ALL SELECT 'p_type', 'one of ' || string_agg(p_type, ', ' ORDER BY f) FROM (SELECT p_type, min(p_partkey) AS f FROM part GROUP BY 1) HAVING count(*) < 20
  UNION ALL SELECT 'p_type', count(DISTINCT p_type) || ' unique values' FROM part HAVING count(DISTINCT p_type) >= 20
  UNION ALL SELECT 'day', 'ranges from ' || strftime(DATE '2020-01-01' + min(p_size)::INT, '%Y-%m-%d 00:00:00') || ' to ' || strftime(DATE '2020-01-01' + max(p_size)::INT, '%Y-%m-%d 00:00:00') FROM part
  UNION ALL SELECT 'p_size', 'range ' || min(p_size) || ' to ' || max(p_size) FROM part UNION ALL SELECT 'empty', 'no data' UNION ALL SELECT 'flag', 'true/false'""")
def a5_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("empty", F.lit(None).cast("string")).withColumn("day", F.expr("date_add(DATE'2020-01-01', cast(p_size AS int))")).withColumn("flag", F.col("p_size") > 3)
    return sheets.describe_columns(part, ["p_name", "p_type", "p_size", "empty", "day", "flag"], "p_partkey")


@query("""SELECT o_orderkey, 'In table ''orders'', row ' || o_orderkey || ': o_custkey is ' || o_custkey || ', note is ' || CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE o_orderpriority END || '.' AS sentence FROM orders""")
def t1_row_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("note", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")))
    return sheets.row_sentences(orders, "orders", "o_orderkey", ["o_custkey", "note"], blank_is_missing=True).select("o_orderkey", "sentence")


@query("""SELECT o_orderkey, 'In section ''' || o_orderpriority || ''', o_custkey is ' || o_custkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ', state is ' || o_orderstatus END || '.' AS sentence FROM orders""")
def t2_section_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return orders.select("o_orderkey", sheets.section_sentence(F.col("o_orderpriority"), ["o_custkey", "state"]).alias("sentence"))


@query("""SELECT o_orderkey, 'Order ' || o_orderkey || ': status is ' || o_orderstatus || ', due date is ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_custkey % 2 = 0 THEN ', responsible party is ' || o_custkey ELSE '' END || '.' AS line FROM orders""")
def t3_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = sheets.checklist_line(F.expr("'Order ' || o_orderkey"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN cast(o_custkey AS string) END"))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("""SELECT s_suppkey::VARCHAR AS r, 'For ' || s_suppkey || ', s_name is ' || s_name || '.' AS sentence FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'For ' || s_suppkey || ', s_nationkey is ' || s_nationkey || '.' FROM supplier WHERE s_nationkey > 3""")
def t4_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("s_nationkey", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey")))
    return sheets.matrix_sentences(s, "s_suppkey", ["s_name", "s_nationkey"]).select("r", "sentence")


@query(f"""WITH {GRID}, v AS (SELECT file, row, string_agg(coalesce(num::VARCHAR, trim(str)), ' ' ORDER BY col) AS line FROM g WHERE coalesce(num::VARCHAR, trim(str), '') <> '' GROUP BY ALL)
  SELECT file, string_agg(line, chr(10) || chr(10) ORDER BY row) AS text FROM v GROUP BY file""")
def t5_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.free_text(grid_rows(spark, sf_dir)).select("file", "text")


@query(f"WITH {ROWS} SELECT file, CASE WHEN count(*) <= 3 THEN 'sentences' ELSE 'table' END AS route, count(*)::BIGINT AS n FROM r GROUP BY file")
def t6_table_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rows(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return n.select("file", sheets.route_table(F.col("n"), 3).alias("route"), "n")


@query(f"""WITH {CELLS}, v AS (SELECT file, sheet, row, string_agg(coalesce(regexp_replace(num::VARCHAR, '\\.0$', ''), trim(str), ''), ' | ' ORDER BY col) AS line FROM cell GROUP BY ALL)
  SELECT file, '## items' || chr(10) || string_agg(line, chr(10) ORDER BY row) AS text FROM v GROUP BY file""")
def s6_t16_pipe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.pipe_text(cell_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT file, row::INTEGER AS row, l_quantity FROM r WHERE row <= 3")
def l3_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sample_rows(rows(spark, sf_dir)).select("file", "row", "l_quantity")


@query(f"WITH {ROWS}, k AS (SELECT file, count(*) AS n, file % 11 = 0 AS hidden FROM r GROUP BY file) SELECT file, CASE WHEN hidden THEN 'W_SHEET_SKIPPED_HIDDEN' WHEN n > 6 THEN 'W_ROWS_TRUNCATED' END AS warning FROM k")
def p11_skip_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = rows(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return k.select("file", sheets.skip_warning(F.col("file") % 11 == 0, F.col("n"), F.lit(5), 6).alias("warning"))


@query("""WITH n AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
  f AS (SELECT *, CASE WHEN name = '' THEN 'column_' || pos ELSE name END AS filled FROM n), s AS (SELECT *, row_number() OVER (PARTITION BY p_brand, filled ORDER BY pos) - 1 AS seen FROM f)
  SELECT p_partkey, CASE WHEN seen = 0 THEN filled ELSE filled || '_' || seen END AS unique_name FROM s""")
def u5_dedup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).withColumn("name", F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_name")))
    return sheets.dedup_names(names, ["p_brand"], "pos", "name").select("p_partkey", "unique_name")


@query(f"""WITH {CELLS}, {PROFILE} SELECT file, CASE WHEN file % 5 <> 0 THEN 'rule_based' WHEN file % 10 / 10.0 >= 0.4 THEN 'llm_basic' ELSE 'llm_reasoning' END AS tier FROM s""")
def c5_excel_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = votes(spark, sf_dir).withColumn("confidence", F.when(F.col("file") % 5 == 0, 0.0).otherwise(F.col("confidence")))
    return open_.select("file", sheets.excel_tier(F.col("confidence"), F.col("file") % 10 / 10 + 0.2).alias("tier"))
