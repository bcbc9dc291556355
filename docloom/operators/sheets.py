"""Spreadsheet operators over typed cells: profiles, votes, headers, sections, regions and sentences.

A cell is a row (file, sheet, row, col, num double, str string): num for numbers and booleans, str for texts, both null for an
empty cell. Rows and columns count from 1. All operators are grouped by file and sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHEET = ["file", "sheet"]
TOTALS = "^(total|sum|grand\\s*total|subtotal)$"


def cell_class(num: Column, str_: Column) -> Column:
    return F.when(num.isNotNull(), "numeric").when(F.coalesce(F.trim(str_), F.lit("")) != "", "text").otherwise("empty")


def classed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("class", cell_class(F.col("num"), F.col("str")))


def packed(cells: DataFrame) -> DataFrame:
    """Rows with their cells in order: file, sheet, row, cells (an array of col, num, str). Frames that are so already stay as they are."""
    if "cells" in cells.columns:
        return cells
    return cells.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", "num", "str"))).alias("cells"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(*SHEET, "row", F.explode("cells").alias("cell")).select(*SHEET, "row", "cell.col", "cell.num", "cell.str")


def sheet_profile(cells: DataFrame) -> DataFrame:
    """n_rows, numeric_ratio and consistency of each sheet that has a value: type_ratios and column_consistency in one pass. cells: as they are or packed."""
    each = packed(cells).select(*SHEET, F.posexplode("cells").alias("at", "cell"))
    of = each.select(*SHEET, F.col("cell.col").alias("col"), cell_class(F.col("cell.num"), F.col("cell.str")).alias("class"), (F.col("at") == 0).alias("first"))
    columns = of.groupBy(*SHEET, "col").agg(F.count_if(F.col("class") == "numeric").alias("numeric"), F.count_if(F.col("class") == "text").alias("text"), F.count(F.lit(1)).alias("all"), F.count_if("first").alias("rows"))
    sheets = columns.groupBy(SHEET).agg(F.sum("rows").alias("n_rows"), F.sum("numeric").alias("numeric"), F.sum("all").alias("all"), F.sum(F.greatest("numeric", "text")).alias("top"), F.sum(F.col("numeric") + F.col("text")).alias("full"))
    return sheets.filter("full > 0").select(*SHEET, "n_rows", (F.col("numeric") / F.col("all")).alias("numeric_ratio"), (F.col("top") / F.col("full")).alias("consistency"))


def type_ratios(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Shares of numeric, text and empty cells of a sheet's data rows: those below its header. headers: file, sheet, header_row (0: none)."""
    share = lambda kind: F.count_if(F.col("class") == kind) / F.count(F.lit(1))
    if headers is not None:
        cells = cells.join(headers.select(*SHEET, "header_row"), SHEET, "left").filter(F.col("row") > F.coalesce("header_row", F.lit(0))).drop("header_row")
    return classed(cells).groupBy(SHEET).agg(share("numeric").alias("numeric_ratio"), share("text").alias("text_ratio"), share("empty").alias("empty_ratio"))


def column_consistency(cells: DataFrame) -> DataFrame:
    """Cells of each column's commonest class over all that aren't empty."""
    counts = classed(cells).filter("class <> 'empty'").groupBy(*SHEET, "col", "class").count()
    tops = counts.groupBy(*SHEET, "col").agg(F.max("count").alias("top"), F.sum("count").alias("all"))
    return tops.groupBy(SHEET).agg((F.sum("top") / F.sum("all")).alias("consistency"))


def data_bounds(cells: DataFrame) -> DataFrame:
    full = classed(cells).filter("class <> 'empty'")
    return full.groupBy(SHEET).agg(F.min("row").alias("row_0"), F.max("row").alias("row_1"), F.min("col").alias("col_0"), F.max("col").alias("col_1"))


def header_rows(cells: DataFrame, within: int = 20, fill: float = 0.5) -> DataFrame:
    """The first of the first rows with two texts or more, nothing else, that fill half of their span; 0 if there is none."""
    rows = classed(cells).filter(F.col("row") <= within).groupBy(*SHEET, "row")
    stats = rows.agg(
        F.count_if(F.col("class") == "text").alias("texts"),
        F.count_if(F.col("class") == "numeric").alias("numbers"),
        F.min(F.when(F.col("class") != "empty", F.col("col"))).alias("a"),
        F.max(F.when(F.col("class") != "empty", F.col("col"))).alias("b"),
    )
    good = (F.col("texts") >= 2) & (F.col("numbers") == 0) & (F.col("texts") / (F.col("b") - F.col("a") + 1) >= fill)
    return stats.groupBy(SHEET).agg(F.coalesce(F.min(F.when(good, F.col("row"))), F.lit(0)).alias("header_row"))


def sheet_vote(profile: DataFrame) -> DataFrame:
    """Five signals of a sheet and what they say. profile: n_rows, merged_ratio, consistency, header_row, numeric_ratio."""
    signals = [
        F.col("n_rows") >= 5,
        F.col("merged_ratio") < 0.05,
        F.col("consistency") >= 0.7,
        F.col("header_row") > 0,
        F.col("numeric_ratio") >= 0.3,
    ]
    votes = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    voted = profile.withColumn("signals", votes)
    kind = F.when(F.col("signals") >= 3, "tabular_data").otherwise("formatted_document")
    confidence = F.when(F.col("signals").isin(5, 4, 1, 0), 0.9).otherwise(0.7)
    return voted.withColumn("sheet_type", kind).withColumn("confidence", confidence)


def file_vote(sheets: DataFrame) -> DataFrame:
    """Sheets that agree give the file their type and the least confidence; otherwise it is hybrid; undecided sheets give 0."""
    g = sheets.groupBy("file").agg(F.count_distinct("sheet_type").alias("kinds"), F.min("sheet_type").alias("one"), F.min("confidence").alias("least"), F.count_if(F.col("sheet_type").isNull()).alias("open"))
    kind = F.when((F.col("open") > 0) | (F.col("kinds") != 1), "hybrid").otherwise(F.col("one"))
    confidence = F.when(F.col("open") > 0, 0.0).when(F.col("kinds") == 1, F.col("least")).otherwise(0.9)
    return g.select("file", kind.alias("file_type"), confidence.alias("confidence"))


def without_totals(cells: DataFrame) -> DataFrame:
    """Cells less empty rows, and less the rows at the end whose first text says that they are totals."""
    rows = classed(cells).filter("class <> 'empty'").groupBy(*SHEET, "row").agg(F.min_by("str", F.when(F.col("class") == "text", F.col("col"))).alias("label"))
    last = rows.filter(~F.coalesce(F.lower(F.trim("label")), F.lit("")).rlike(TOTALS)).groupBy(SHEET).agg(F.max("row").alias("last"))
    kept = rows.join(last, SHEET).filter(F.col("row") <= F.col("last")).select(*SHEET, "row")
    return cells.join(kept, [*SHEET, "row"], "left_semi")


def row_gaps(cells: DataFrame, axis: str = "row", least: int = 2) -> DataFrame:
    """Runs of `least` or more rows (or columns) without data between others: start and length."""
    lines = classed(cells).groupBy(*SHEET, axis).agg(F.count_if(F.col("class") != "empty").alias("full")).filter("full > 0")
    before = F.lag(axis).over(Window.partitionBy(SHEET).orderBy(axis))
    return lines.withColumn("before", before).filter(F.col(axis) - F.col("before") > least).select(*SHEET, (F.col("before") + 1).alias("start"), (F.col(axis) - F.col("before") - 1).alias("length"))


def turns(window: int, heavy: float) -> Column:
    """Whether the `window` rows before a row and those from it on differ in what they mostly hold. Rows with n (numbers) and all (cells with data)."""
    by_row = Window.partitionBy(SHEET).orderBy("row")
    share = lambda w: F.sum("n").over(w) / F.nullif(F.sum("all").over(w), F.lit(0))
    above, below = share(by_row.rowsBetween(-window, -1)), share(by_row.rowsBetween(0, window - 1))
    turn = ((above >= heavy) & (below <= 1 - heavy + 1e-12)) | ((above <= 1 - heavy + 1e-12) & (below >= heavy))
    return F.coalesce(turn, F.lit(False))


def format_transitions(cells: DataFrame, window: int = 5, heavy: float = 0.6) -> DataFrame:
    """Rows where `window` rows mostly of numbers meet as many mostly of text, or the other way round."""
    rows = classed(cells).groupBy(*SHEET, "row").agg(F.count_if(F.col("class") == "numeric").alias("n"), F.count_if(F.col("class") != "empty").alias("all"))
    return rows.withColumn("turn", turns(window, heavy)).filter("turn").select(*SHEET, "row")


def row_kinds(cells: DataFrame) -> DataFrame:
    """A row's columns of numbers and of texts, and how many cells hold a number (n) or anything (all). cells: as they are or packed."""
    if "cells" in cells.columns:
        of = lambda kind: F.transform(F.filter("cells", lambda c: cell_class(c["num"], c["str"]) == kind), lambda c: c["col"]).alias(kind)
        # A file's rows meet here, and nothing after this is shuffled again (by file alone: a constant sheet wouldn't count as a key).
        rows = cells.select(*SHEET, "row", of("numeric"), of("text")).repartition("file")
        n, full = F.sum(F.size("numeric")), F.sum(F.size("numeric") + F.size("text"))
        columns = [F.flatten(F.collect_list(kind)).alias(kind) for kind in ("numeric", "text")]
    else:
        rows = classed(cells)
        n, full = F.count_if(F.col("class") == "numeric"), F.count_if(F.col("class") != "empty")
        columns = [F.collect_list(F.when(F.col("class") == kind, F.col("col"))).alias(kind) for kind in ("numeric", "text")]
    return rows.groupBy(*SHEET, "row").agg(n.alias("n"), full.alias("all"), *columns)


def cut_rows(cells: DataFrame, window: int = 5, heavy: float = 0.6, least: int = 2) -> DataFrame:
    """row_kinds with what cuts the sheet: gap (`least` or more rows without data lie between `before` and this one) and turn (format_transitions)."""
    by_row = Window.partitionBy(SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("all") > 0, F.col("row")), ignorenulls=True).over(by_row)
    gap = F.coalesce((F.col("all") > 0) & (F.col("row") - F.col("before") > least), F.lit(False))
    return row_kinds(cells).withColumn("before", before).withColumn("turn", turns(window, heavy)).withColumn("gap", gap)


def boundaries(cells: DataFrame, window: int = 5, heavy: float = 0.6, least: int = 2) -> DataFrame:
    """Where a sheet is cut: starts of gaps and transitions, each once."""
    at = F.array(F.when(F.col("gap"), F.col("before") + 1), F.when(F.col("turn"), F.col("row")))
    return cut_rows(cells, window, heavy, least).select(*SHEET, F.explode(at).alias("row")).filter("row is not null").distinct()


def region_rows(cells: DataFrame, window: int = 5, heavy: float = 0.6, least: int = 2) -> DataFrame:
    """Rows with data and the part of the sheet they lie in: as many as cuts come before; a sheet without cuts is one."""
    upto = Window.partitionBy(SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum((F.col("gap") | F.col("turn")).cast("int")).over(upto)
    return cut_rows(cells, window, heavy, least).withColumn("part", part).filter("all > 0").select(*SHEET, "row", "part", "numeric", "text")


def numbered(parts: DataFrame) -> DataFrame:
    return parts.withColumn("region", F.row_number().over(Window.partitionBy(SHEET).orderBy("part"))).drop("part")


def regions(rows: DataFrame) -> DataFrame:
    """Boxes between the cuts that hold data, numbered by sheet. rows: of region_rows."""
    edge = lambda pick, of: pick(of("numeric"), of("text"))
    boxes = rows.groupBy(*SHEET, "part").agg(F.min("row").alias("row_0"), (F.max("row") + 1).alias("row_1"), F.min(edge(F.least, F.array_min)).alias("col_0"), (F.max(edge(F.greatest, F.array_max)) + 1).alias("col_1"))
    return numbered(boxes)


def single_type_share(rows: DataFrame) -> DataFrame:
    """Share of a region's columns that hold one class only: a region's measure, unlike the sheet's. rows: of region_rows."""
    columns = rows.groupBy(*SHEET, "part").agg(*(F.array_distinct(F.flatten(F.collect_list(kind))).alias(kind) for kind in ("numeric", "text")))
    counts = columns.select(*SHEET, "part", (F.size("numeric") + F.size("text")).alias("kinds"), F.size(F.array_intersect("numeric", "text")).alias("mixed"))
    # A mixed column counts as two kinds.
    return numbered(counts.select(*SHEET, "part", ((F.col("kinds") - 2 * F.col("mixed")) / (F.col("kinds") - F.col("mixed"))).alias("single_type_share")))


def merged_values(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells inside a merged range take its top left value. merges: file, sheet, row_0, row_1, col_0, col_1 (inclusive)."""
    top = merges.join(cells.select(*SHEET, F.col("row").alias("row_0"), F.col("col").alias("col_0"), F.col("num").alias("m_num"), F.col("str").alias("m_str")), [*SHEET, "row_0", "col_0"])
    spread = top.select(*SHEET, F.explode(F.sequence("row_0", "row_1")).alias("row"), "col_0", "col_1", "m_num", "m_str").select(*SHEET, "row", F.explode(F.sequence("col_0", "col_1")).alias("col"), "m_num", "m_str", F.lit(True).alias("merged"))
    both = cells.join(spread, [*SHEET, "row", "col"], "left")
    pick = lambda own, of: F.when(F.col("merged"), F.col(of)).otherwise(F.col(own)).alias(own)
    return both.select(*SHEET, "row", "col", pick("num", "m_num"), pick("str", "m_str"))


def sections(rows: DataFrame) -> DataFrame:
    """Numbers runs of rows between breaks. rows: file, sheet, row, is_blank, is_title (a merged header), title.

    A title's row begins a section that carries its text; a blank row ends one. Blank and title rows aren't in the result.
    """
    by_row = Window.partitionBy(SHEET).orderBy("row")
    upto = by_row.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__part", F.sum((F.col("is_blank") | F.col("is_title")).cast("int")).over(upto)).withColumn("section_title", F.last(F.when(F.col("is_title"), F.col("title")), ignorenulls=True).over(upto))
    body = marked.filter(~F.col("is_blank") & ~F.col("is_title"))
    return body.withColumn("section", F.dense_rank().over(Window.partitionBy(SHEET).orderBy("__part"))).drop("__part", "is_blank", "is_title", "title")


def section_structure(header: Column, n_columns: Column, corner_empty: Column, has_row_labels: Column) -> Column:
    """checklist, matrix, table or free_text, in this order. header: lower-cased header cells."""
    status = F.exists(header, lambda h: h.rlike("\\b(status|done|complete|completed|state|progress)\\b"))
    return F.when(status, "checklist").when(corner_empty & has_row_labels & (n_columns >= 2), "matrix").when(n_columns >= 2, "table").otherwise("free_text")


def sentence_pairs(columns: list[str], names: list[str] | None = None, missing: str | None = "N/A", blank_is_missing: bool = False) -> Column:
    """`c is v, d is w` over columns of a frame; missing=None leaves empty values out."""
    parts = []
    for column, name in zip(columns, names or columns, strict=True):
        value = F.col(column).cast("string")
        value = F.nullif(F.trim(value), F.lit("")) if blank_is_missing else value
        parts.append(F.concat(F.lit(f"{name} is "), F.coalesce(value, F.lit(missing)) if missing is not None else value))
    return F.concat_ws(", ", *parts)


def row_sentences(table: DataFrame, name: str, number: str, columns: list[str], blank_is_missing: bool = False) -> DataFrame:
    text = F.concat(F.lit(f"In table '{name}', row "), F.col(number).cast("string"), F.lit(": "), sentence_pairs(columns, blank_is_missing=blank_is_missing), F.lit("."))
    return table.withColumn("sentence", text)


def section_sentence(section: Column, columns: list[str]) -> Column:
    return F.concat(F.lit("In section '"), section, F.lit("', "), sentence_pairs(columns, missing=None), F.lit("."))


def checklist_line(item: Column, status: Column, due: Column | None = None, owner: Column | None = None) -> Column:
    parts = [F.concat(F.lit("status is "), status)]
    if due is not None:
        parts.append(F.concat(F.lit("due date is "), due))
    if owner is not None:
        parts.append(F.concat(F.lit("responsible party is "), owner))
    return F.concat(item, F.lit(": "), F.concat_ws(", ", *parts), F.lit("."))


def matrix_sentences(table: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """`For r, c is v.` for each value of a matrix that isn't empty."""
    long = table.select(F.col(label).cast("string").alias("r"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("r", columns, "c", "v")
    return long.filter(F.coalesce(F.trim("v"), F.lit("")) != "").withColumn("sentence", F.format_string("For %s, %s is %s.", "r", "c", "v"))


def free_text(cells: DataFrame, title: str | None = None) -> DataFrame:
    """Cells of a row joined by spaces, rows by blank lines. cells: as they are or packed."""
    values = F.filter(F.transform("cells", lambda c: F.coalesce(c["num"].cast("string"), F.trim(c["str"]))), lambda v: v.isNotNull() & (v != ""))
    # What an explode gives isn't computed again for the filter.
    rows = packed(cells).select(*SHEET, "row", F.explode(F.array(F.array_join(values, " "))).alias("line")).filter("line <> ''")
    body = rows.groupBy(SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    return body if title is None else body.withColumn("text", F.concat(F.lit(title + "\n\n"), F.col("text")))


def pipe_text(cells: DataFrame) -> DataFrame:
    """A workbook as text: `## sheet` and its rows with cells joined by pipes; empty sheets are left out. cells: as they are or packed."""
    value = lambda c: F.coalesce(F.regexp_replace(c["num"].cast("string"), "\\.0$", ""), F.trim(c["str"]), F.lit(""))
    rows = packed(cells).select(*SHEET, "row", F.explode(F.array(F.transform("cells", value))).alias("v")).filter(F.exists("v", lambda v: v != "")).withColumn("line", F.array_join("v", " | "))
    sheets = rows.groupBy(SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = sheets.select("file", "sheet", F.concat(F.lit("## "), F.col("sheet"), F.lit("\n"), F.col("body")).alias("part"))
    return parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def describe_columns(table: DataFrame, columns: list[str], order: str, few: int = 20) -> DataFrame:
    """A row per column: what a reader should know of it (no data, range, true/false, one of a few, number of values).

    The few are named in the order in which they are first seen, by `order`. Different values are counted and ranked as rows of
    their own, so no column's values come together in one place.
    """
    kinds = dict(table.dtypes)
    numbers = [c for c in columns if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    times = [c for c in columns if kinds[c] in ("date", "timestamp", "timestamp_ntz")]
    others = [c for c in columns if c not in numbers + times and kinds[c] != "boolean"]
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("string")
    aggregates = [F.count(c).alias(f"{c}__n") for c in columns]
    aggregates += [f(c).alias(f"{c}__{name}") for c in numbers + times for name, f in (("lo", F.min), ("hi", F.max))]
    one = table.agg(*aggregates)
    text = lambda c, end: one[f"{c}__{end}"].cast("string") if c in numbers else F.date_format(one[f"{c}__{end}"], "yyyy-MM-dd HH:mm:ss")
    rows = []
    for c in columns:
        if c in numbers:
            rest = F.concat(F.lit("range "), text(c, "lo"), F.lit(" to "), text(c, "hi"))
        elif c in times:
            rest = F.concat(F.lit("ranges from "), text(c, "lo"), F.lit(" to "), text(c, "hi"))
        else:
            rest = F.lit("true/false") if kinds[c] == "boolean" else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"{c}__n") == 0, "no data").otherwise(rest).alias("description")))
    found = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if not others:
        return found
    long = table.select(F.col(order).alias("__at"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), shown(c).alias("v")) for c in others))).alias("x")).filter("x.v is not null")
    values = long.groupBy("x.column_name", "x.v").agg(F.min("__at").alias("first"))
    counts = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("d"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy("first", "v"))).filter(F.col("rank") < few)
    named = ranked.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"]), ", ").alias("names"))
    told = F.when(F.col("d") < few, F.concat(F.lit("one of "), "names")).when(F.col("d").isNotNull(), F.concat(F.col("d").cast("string"), F.lit(" unique values")))
    return found.join(counts.join(named, "column_name"), "column_name", "left").select("column_name", F.coalesce("description", told).alias("description"))


def file_rollup(cells: DataFrame) -> DataFrame:
    """Sheets, rows and empty cells of each file."""
    per_sheet = classed(cells).groupBy(*SHEET).agg(F.count_distinct("row").alias("rows"), F.count_if(F.col("class") == "empty").alias("empty"))
    return per_sheet.groupBy("file").agg(F.count(F.lit(1)).alias("n_sheets"), F.sum("rows").alias("n_rows"), F.sum("empty").alias("empty_cells"))


def skip_warning(hidden: Column, n_rows: Column, n_columns: Column, most_rows: int) -> Column:
    """Why a sheet is left out or cut (hidden, without cells, too long); null: it isn't."""
    return F.when(hidden, "W_SHEET_SKIPPED_HIDDEN").when((n_rows == 0) | (n_columns == 0), "W_SHEET_SKIPPED_EMPTY").when(n_rows > most_rows, "W_ROWS_TRUNCATED")


def sample_rows(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first n rows of each sheet, by row."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))).filter(F.col("__rank") <= n).drop("__rank")


def excel_tier(confidence: Column, answered: Column) -> Column:
    """The tier of a workbook's class: by rule, unless that left it open (0.0); then a language model's, and a better one's below 0.6."""
    return F.when(confidence > 0, "rule_based").when(answered >= 0.6, "llm_basic").otherwise("llm_reasoning")


def route_sheet(rows: Column, most: int = 5000) -> Column:
    """Sheets always become a table and a schema chunk; their rows become sentences too if they are under `most`."""
    return F.when(rows < most, F.array(F.lit("table"), F.lit("schema"), F.lit("rows"))).otherwise(F.array(F.lit("table"), F.lit("schema")))


def route_table(rows: Column, most: int = 20) -> Column:
    """Small tables become sentences; others a table of the database and a schema chunk."""
    return F.when(rows <= most, "sentences").otherwise("table")


def dedup_names(names: DataFrame, keys: list[str], position: str, name: str) -> DataFrame:
    """Repeated names get _1, _2, ...; an empty one is column_<position from 0>."""
    filled = names.withColumn("__name", F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.concat(F.lit("column_"), F.col(position).cast("string"))).otherwise(F.col(name)))
    seen = F.row_number().over(Window.partitionBy(*keys, "__name").orderBy(position)) - 1
    return filled.withColumn("unique_name", F.when(seen == 0, F.col("__name")).otherwise(F.concat("__name", F.lit("_"), seen.cast("string")))).drop("__name")
