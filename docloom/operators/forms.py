"""Form operators: fingerprints, template matching, field confidence, template versions, form texts and rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import iou

FORMATS = {"pdf": "pdf", "xlsx": "xlsx", "jpg": "image", "jpeg": "image", "png": "image", "tif": "image", "tiff": "image"}


#: Pages of documents and of templates that are compared at once. If all match, a block has some two million matches (about 100 MB).
DOC_BLOCK, TEMPLATE_BLOCK = 4096, 2048


def source_format(path: Column) -> Column:
    """The format of a form by its extension; null: not supported."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)))


def grid_similarity(a: Column, b: Column) -> Column:
    """Mean over cells of 1 for equal levels, 0.5 for neighbours, 0 else; 0 for grids of different size."""
    points = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).when(F.abs(x - y) == 1, 0.5).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), points / F.size(a)).otherwise(0.0)


def unpack_grid(fingerprint: Column) -> Column:
    """Bytes of a fingerprint as an array of levels."""
    return F.transform(F.sequence(F.lit(1), F.length(fingerprint)), lambda i: F.conv(F.hex(F.substr(fingerprint, i, F.lit(1))), 16, 10).cast("int"))


def _grids(column: pa.ChunkedArray, null: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of all grids in a row, and where each grid starts and how long it is."""
    grids = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(grids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    levels = pc.fill_null(grids.flatten().cast(pa.int64()), null).to_numpy(zero_copy_only=False)
    return levels, np.cumsum(lengths) - lengths, lengths


def _points(a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Points of rows of a with all grids of b: 1 for equal levels, 0.5 for neighbours. Few levels: a product of matrices, exact as all is in halves."""
    known = np.unique(b)
    known = np.intersect1d(np.unique(np.concatenate((known - 1, known, known + 1))), np.unique(a))
    if len(known) <= 16:
        far = np.abs(b[:, :, None] - known)
        right = ((far == 0) + 0.5 * (far == 1)).astype(np.float32).reshape(len(b), -1).T
        return lambda rows: (a[rows][:, :, None] == known).astype(np.float32).reshape(len(rows), -1) @ right

    def each(rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(b)), np.float32)
        for i, row in enumerate(a[rows]):
            far = np.abs(b - row)
            out[i] = (far == 0).sum(1) + 0.5 * (far == 1).sum(1)
        return out

    return each


def _numbers(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    known = values.combine_chunks().dictionary_encode()
    return known.indices.to_numpy(), known.dictionary


def match_block(docs: pa.Table, templates: pa.Table, page_min: float, extra: float) -> pa.Table:
    """match_pages of some documents and templates of one format, all pages of each."""
    doc, doc_names = _numbers(docs["doc"])
    of = pd.MultiIndex.from_arrays([_numbers(templates["template"])[0], _numbers(templates["version"])[0]])
    template, _ = pd.factorize(of)
    page, t_page = docs["page"].to_numpy().astype(np.int64), templates["t_page"].to_numpy().astype(np.int64)
    levels, at, size = _grids(docs["grid"], -(1 << 40))
    t_levels, t_at, t_size = _grids(templates["t_grid"], 1 << 40)
    d_n = np.bincount(doc, minlength=len(doc_names))
    span = int(page.max() - page.min()) + 1
    order = np.argsort(doc * span + (page - page.min()), kind="stable")
    key = (doc * span + (page - page.min()))[order]
    # Templates whose pages have the same numbers and sizes are compared together.
    alike: dict[tuple, list[np.ndarray]] = {}
    by = np.lexsort((t_page, template))
    for rows in np.split(by, np.flatnonzero(np.diff(template[by])) + 1):
        alike.setdefault((tuple(t_page[rows]), tuple(t_size[rows])), []).append(rows)
    out = []
    for (numbers, sizes), members in alike.items():
        n, members = len(numbers), np.array(members)
        if min(sizes) == 0:
            continue
        starts = np.maximum(d_n - n + 1, 0)
        of_doc = np.repeat(np.arange(len(d_n)), starts)
        start = np.arange(len(of_doc)) - np.repeat(np.cumsum(starts) - starts, starts)
        wanted = start[:, None] + np.array(numbers) - page.min()
        inside = ((wanted >= 0) & (wanted < span)).all(1)
        of_doc, start, wanted = of_doc[inside], start[inside], of_doc[inside, None] * span + wanted[inside]
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        rows = order[place]
        full = (key[place] == wanted).all(1) & (size[rows] == np.array(sizes)).all(1)
        of_doc, start, rows = of_doc[full], start[full], rows[full]
        if not len(rows):
            continue
        points = []
        for k, length in enumerate(sizes):
            used, back = np.unique(rows[:, k], return_inverse=True)
            grid = levels[at[used][:, None] + np.arange(length)]
            points.append((_points(grid, t_levels[t_at[members[:, k]][:, None] + np.arange(length)]), back))
        least = [next((m / 2 for m in range(2 * length + 1) if m / 2 / length >= page_min), np.inf) for length in sizes]
        for lo in range(0, len(rows), 512):
            some = [f(back[lo : lo + 512]) for f, back in points]
            good = np.logical_and.reduce([p >= m for p, m in zip(some, least)])
            w, t = np.nonzero(good)
            mean = sum(p[w, t].astype(np.float64) / length for p, length in zip(some, sizes)) / n
            own = of_doc[lo + w]
            out.append((own.astype(np.int32), members[t, 0].astype(np.int32), start[lo + w].astype(np.int32), mean - (d_n[own] - n) * extra))
    own, first, start, confidence = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0))
    best = np.lexsort((start, -confidence, first, own))
    own, first = own[best], first[best]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (first[1:] != first[:-1])
    own, first, best = own[new], first[new], best[new]
    return pa.table({"doc": doc_names.take(pa.array(own)), "template": templates["template"].take(pa.array(first)), "version": templates["version"].take(pa.array(first)), "start": pa.array(start[best], pa.int64()), "confidence": pa.array(confidence[best], pa.float64())})


def match_pages(doc_pages: DataFrame, template_pages: DataFrame, page_min: float = 0.6, extra: float = 0.02) -> DataFrame:
    """The best place of each template in each document: doc, template, version, start, confidence.

    doc_pages: doc, format, page, grid. template_pages: template, version, format, page, grid; a page number comes once. A template
    of T pages slides over D >= T pages; every page must reach page_min; the score is the mean less `extra` for each page left over;
    ties: first start. All documents meet all templates of their format, in blocks of bounded size that are compared by products of
    matrices; each block of either side goes to each block of the other, and only matches come back.
    """
    d, t = doc_pages.select("doc", "format", "page", "grid").dropna(subset=["doc", "format"]), template_pages.dropna(subset=["template", "version", "format"])
    # Under names of their own: both sides may come from one table, whose columns would be taken for each other.
    t = t.select("template", "version", F.col("format").alias("t_format"), F.col("page").alias("t_page"), F.col("grid").alias("t_grid"))
    parts = lambda frame, most: max(1, -(-frame.count() // most))
    n_d, n_t = parts(d, DOC_BLOCK), parts(t, TEMPLATE_BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = d.withColumn("__d", F.pmod(F.hash("doc"), F.lit(n_d))).withColumn("__t", spread(n_t))
    right = t.withColumn("__t", F.pmod(F.hash("template", "version"), F.lit(n_t))).withColumn("__d", spread(n_d))
    kinds = dict(d.dtypes) | dict(t.select("template", "version").dtypes)
    schema = f"doc {kinds['doc']}, template {kinds['template']}, version {kinds['version']}, start bigint, confidence double"
    names = [x.split()[0] for x in schema.split(", ")]

    kinds = {f.name: f.type for f in d.select("doc").limit(0).toArrow().schema} | {f.name: f.type for f in t.select("template", "version").limit(0).toArrow().schema}
    empty = pa.table({name: pa.array([], kinds.get(name, pa.int64() if name == "start" else pa.float64())) for name in names})

    def run(docs: pa.Table, templates: pa.Table) -> pa.Table:
        if not docs.num_rows or not templates.num_rows:
            return empty
        return match_block(docs, templates, page_min, extra)

    found = left.groupBy("format", "__d", "__t").cogroup(right.groupBy("t_format", "__d", "__t")).applyInArrow(run, schema)
    wide = "bigint" if "bigint" in (dict(d.dtypes)["page"], dict(t.dtypes)["t_page"]) else "int"
    return found.withColumn("start", F.col("start").cast(wide))


def top_matches(matches: DataFrame, floor: float = 0.5, accept: float = 0.8) -> DataFrame:
    """Matches from the floor on, best first, and whether the first one is accepted."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("confidence"), "template"))
    ranked = matches.filter(F.col("confidence") >= floor).withColumn("match_rank", rank)
    return ranked.withColumn("accepted", (F.col("match_rank") == 1) & (F.col("confidence") >= accept))


def fields_from_widgets(fields: DataFrame, widgets: DataFrame, least: float = 0.5) -> DataFrame:
    """For each field the widget of its page that overlaps most (ties: the first). Both: doc, page, x, y, w, h; field / place, value."""
    f, w = fields.alias("f"), widgets.alias("w")
    box = lambda a: {k: F.col(f"{a}.{k}") for k in ("x", "y", "w", "h")}
    met = f.join(w, (F.col("f.doc") == F.col("w.doc")) & (F.col("f.page") == F.col("w.page"))).withColumn("iou", iou(box("f"), box("w"))).filter(F.col("iou") >= least)
    flat = met.select("f.doc", "f.page", "f.field", "w.place", "w.value", "iou")
    best = F.row_number().over(Window.partitionBy("doc", "field").orderBy(F.desc("iou"), "place"))
    return flat.withColumn("r", best).filter("r = 1").drop("r")


def overall_confidence(fields: DataFrame, template_fields: DataFrame) -> DataFrame:
    """Weighted mean by document: required fields weigh 2, others 1, unknown ones 1. fields: doc, template, field, confidence."""
    known = template_fields.select("template", "field", F.when(F.col("required"), 2.0).otherwise(1.0).alias("weight"))
    met = fields.join(known, ["template", "field"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    g = met.groupBy("doc").agg(F.sum(F.col("confidence") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return g.select("doc", (F.col("s") / F.greatest("w", F.lit(1.0))).alias("confidence"))


def character_confidence(characters: Column, whole: Column) -> Column:
    """The mean of the characters' confidences, or that of the whole reading where there are none."""
    total = F.aggregate(characters, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(characters) > 0, total / F.size(characters)).otherwise(whole)


def range_value(cells: DataFrame) -> DataFrame:
    """The cells of a range, row by row, less empty ones, joined by line feeds. cells: doc, field, row, col, value."""
    full = cells.withColumn("v", F.trim("value")).filter("v <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "v"))), lambda x: x["v"]), "\n")
    some = full.groupBy("doc", "field").agg(text.alias("value"))
    return cells.select("doc", "field").distinct().join(some, ["doc", "field"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def cell_value(value: Column, required: Column, default: Column) -> Column:
    """(value, confidence, warning) of a mapped cell: an empty one has its default at 0.95, or, required, none at 0."""
    empty = F.coalesce(F.trim(value), F.lit("")) == ""
    return F.struct(
        F.when(~empty, value).when(~required, default).alias("value"),
        F.when(~empty, F.lit(0.95)).when(required, F.lit(0.0)).otherwise(F.lit(0.95)).alias("confidence"),
        F.when(empty & required, "W_FORM_FIELD_MISSING_REQUIRED").alias("warning"),
    )


def stored_value(value: Column, kind: Column) -> Column:
    """How a table stores a field: checkboxes and signatures as 1, 0 or null, all else as it is."""
    flag = F.when(value.isNull(), None).when(F.lower(value).isin("true", "1", "yes"), "1").otherwise("0")
    return F.when(kind.isin("checkbox", "signature"), flag).otherwise(value)


def choose_extractor(format_: Column, has_widgets: Column, has_native: Column, has_ocr: Column) -> Column:
    """(method, error): which extractor reads a form, or why none can."""
    ocr = F.when(has_ocr, F.struct(F.lit("ocr_overlay").alias("method"), F.lit(None).cast("string").alias("error")))
    none = lambda code: F.struct(F.lit(None).cast("string").alias("method"), F.lit(code).alias("error"))
    one = lambda method: F.struct(F.lit(method).alias("method"), F.lit(None).cast("string").alias("error"))
    native = F.when(has_native, one("native_fields")).otherwise(none("E_FORM_NATIVE_FIELDS_UNAVAILABLE"))
    return (
        F.when(format_ == "xlsx", one("cell_mapping"))
        .when((format_ == "pdf") & has_widgets, native)
        .when(format_.isin("pdf", "image"), F.coalesce(ocr, none("E_FORM_OCR_FAILED")))
        .otherwise(none("E_FORM_UNSUPPORTED_FORMAT"))
    )


def fail_closed(fields: DataFrame, overall: DataFrame, least: float = 0.3) -> DataFrame:
    """No value of a document is written whose overall confidence is under `least`. overall: doc, confidence."""
    known = overall.select("doc", F.col("confidence").alias("__overall"))
    met = fields.join(known, "doc", "left")
    return met.withColumn("value", F.when(F.coalesce(F.col("__overall") >= least, F.lit(False)), F.col("value"))).drop("__overall")


def vlm_candidates(fields: DataFrame, below: float = 0.4, budget: int = 10) -> DataFrame:
    """Fields that a vision model should read again: the weak ones, required and weakest first, `budget` a document."""
    weak = fields.filter(F.col("confidence") < below)
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("required").desc(), "confidence", "place"))
    return weak.withColumn("budget_rank", rank).withColumn("in_budget", F.col("budget_rank") <= budget)


def with_vlm(fields: DataFrame, readings: DataFrame, least: float = 0.5) -> DataFrame:
    """Readings that are sure enough replace value and confidence. readings: doc, field, vlm_value, vlm_confidence."""
    met = fields.join(readings, ["doc", "field"], "left")
    better = F.coalesce(F.col("vlm_confidence") >= least, F.lit(False))
    pick = lambda own, other: F.when(better, F.col(other)).otherwise(F.col(own)).alias(own)
    rest = [c for c in fields.columns if c not in ("value", "confidence")]
    return met.select(*rest, pick("value", "vlm_value"), pick("confidence", "vlm_confidence"), F.when(better, "vlm").otherwise("native").alias("method"))


# Template versions: an append-only table (template, version, status, name, fingerprint) and tombstones (template, version; a
# null version deletes all).


STATUSES = ("draft", "approved", "archived")


def created_templates(requests: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First versions of new templates, and the refused requests with a code.

    requests: template, name, status (null: draft), format, fingerprint (null if it couldn't be made); fields: template, field,
    pattern. A status that isn't known, or a pattern that is no regular expression, refuses a template.
    """

    @F.pandas_udf("boolean")
    def broken(patterns: pd.Series) -> pd.Series:
        def bad(pattern: str | None) -> bool:
            try:
                re.compile(pattern or "")
            except re.error:
                return True
            return False

        return patterns.map(bad)

    wrong = fields.filter(broken("pattern")).select("template").distinct().withColumn("__bad", F.lit(True))
    met = requests.withColumn("status", F.coalesce("status", F.lit("draft"))).join(wrong, "template", "left")
    refused = F.coalesce("__bad", F.lit(False)) | ~F.col("status").isin(*STATUSES)
    made = met.filter(~refused).drop("__bad").withColumn("version", F.lit(1))
    return made, met.filter(refused).select("template", "name", F.lit("E_FORM_TEMPLATE_INVALID").alias("error"))


def live_versions(versions: DataFrame, tombstones: DataFrame) -> DataFrame:
    whole = tombstones.filter("version is null").select("template").distinct()
    return versions.join(tombstones.filter("version is not null"), ["template", "version"], "left_anti").join(whole, "template", "left_anti")


def latest_versions(versions: DataFrame, tombstones: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("version")))
    return live_versions(versions, tombstones).withColumn("r", newest).filter("r = 1").drop("r")


def resolve_requests(requests: DataFrame, versions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """requests: request, template, version (null: latest), format. Adds the version found, or an error code."""
    live = live_versions(versions, tombstones).select(F.col("template").alias("t"), F.col("version").alias("found"), F.col("format").alias("t_format"))
    latest = live.groupBy(F.col("t").alias("template")).agg(F.max("found").alias("latest"))
    asked = requests.join(latest, "template", "left").withColumn("want", F.coalesce("version", "latest"))
    met = asked.join(live, (F.col("template") == F.col("t")) & (F.col("want") == F.col("found")), "left")
    error = F.when(F.col("found").isNull(), "E_FORM_TEMPLATE_NOT_FOUND").when(F.col("t_format") != F.col("format"), "E_FORM_FORMAT_MISMATCH")
    return met.select("request", "template", "found", error.alias("error"))


def updated_version(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows to append for updates: the next version, which is a draft again if its structure changed. changes: template, name, fingerprint."""
    c = changes.select("template", F.col("name").alias("new_name"), F.col("fingerprint").alias("new_fingerprint"))
    met = current.join(c, "template")
    structural = F.col("new_fingerprint").isNotNull() & ~F.col("new_fingerprint").eqNullSafe(F.col("fingerprint"))
    status = F.when(structural, "draft").otherwise(F.col("status"))
    return met.select("template", (F.col("version") + 1).alias("version"), status.alias("status"), F.coalesce("new_name", "name").alias("name"), F.coalesce("new_fingerprint", "fingerprint").alias("fingerprint"))


def approved(current: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows to append for approvals; only drafts can be approved."""
    return current.join(asked.select("template"), "template", "left_semi").filter("status = 'draft'").withColumn("version", F.col("version") + 1).withColumn("status", F.lit("approved"))


def archived(current: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and tombstones to append for deletions."""
    gone = current.join(asked.select("template"), "template", "left_semi")
    return gone.withColumn("version", F.col("version") + 1).withColumn("status", F.lit("archived")), gone.select("template", F.lit(None).cast("int").alias("version"))


def field_groups(fields: DataFrame, most: int = 20) -> DataFrame:
    """One group for a small form, otherwise one for each page. fields: doc, field, page."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    return fields.withColumn("group", F.when(n <= most, 0).otherwise(F.coalesce("page", F.lit(0))))


def form_texts(fields: DataFrame, date: str) -> DataFrame:
    """Text of each group of a form's fields. fields: doc, form, version, group, place, label, value (string), flag (boolean)."""
    shown = F.coalesce(F.when(F.col("flag").isNotNull(), F.when(F.col("flag"), "Yes").otherwise("No")), F.col("value"), F.lit("[not extracted]"))
    lines = fields.withColumn("line", F.concat("label", F.lit(": "), shown)).groupBy("doc", "form", "version", "group")
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("Form: "), F.col("form"), F.lit(" (v"), F.col("version").cast("string"), F.lit(f")\nDate Extracted: {date}\n\n"))
    return body.select("doc", "group", F.concat(head, F.col("body")).alias("text"))


def best_readings(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last one by `order`: how rows are written again under their key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def fill_grid(pixels: DataFrame, columns: int, rows: int, width: int, height: int) -> DataFrame:
    """Share of dark pixels of each grid cell, and its level. pixels: doc, page, x, y, dark (0 or 1)."""
    from docloom.functions.text import fill_level

    cell = pixels.withColumn("cx", F.least(F.floor(F.col("x") * columns / width), F.lit(columns - 1)).cast("int")).withColumn("cy", F.least(F.floor(F.col("y") * rows / height), F.lit(rows - 1)).cast("int"))
    return cell.groupBy("doc", "page", "cy", "cx").agg(F.avg("dark").alias("ratio")).withColumn("level", fill_level(F.col("ratio")))
