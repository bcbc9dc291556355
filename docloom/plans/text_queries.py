"""Queries over documents, pages, conversations and events: keys, scans, chunks, text functions, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import ids, text
from docloom.operators import chains, chunking
from docloom.plans.registry import query, table
from docloom.sources import decode, files

URI = "source || '/' || doc_id || '.txt'"
KEY = f"sha256(sha256(text) || '|' || {URI} || '|1')"
EXT = "CASE doc_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'XLSX' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'eml' WHEN 5 THEN 'png' WHEN 6 THEN 'rtf' WHEN 7 THEN 'doc' WHEN 8 THEN 'xls' ELSE 'bin' END"
WORDS = "CASE WHEN trim({0}) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')) END"


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("uri", F.expr("source || '/' || doc_id || '.txt'"))
    return docs.withColumn("ingest_key", ids.ingest_key(ids.content_hash(F.col("text")), F.col("uri"), F.lit("1")))


@query("SELECT doc_id, sha256(text) AS content_hash, octet_length(encode(text))::BIGINT AS size FROM documents")
def s1_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))


@query(f"SELECT doc_id, sha256(sha256(text) || '|' || {URI} || '|1' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '|' || source END) AS ingest_key FROM documents")
def s2_ingest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("uri", F.expr("source || '/' || doc_id || '.txt'"))
    tenant = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return docs.select("doc_id", ids.ingest_key(ids.content_hash(F.col("text")), F.col("uri"), F.lit("1"), tenant).alias("ingest_key"))


@query(f"""SELECT doc_id, CASE lower({EXT}) WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'excel' WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'eml' THEN 'email'
  WHEN 'png' THEN 'image' WHEN 'rtf' THEN 'rtf' WHEN 'doc' THEN 'doc' WHEN 'xls' THEN 'xls' END AS format FROM documents""")
def s3_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(f"source || '/a.b/' || doc_id || '.' || {EXT}"))
    return docs.select("doc_id", files.file_format(F.col("path")).alias("format"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS line FROM events")
def t7_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(decode.flat_object(F.col("props"))).alias("line"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS line, 1 AS total_keys, 0 AS max_depth, false AS truncated FROM events")
def t7_json_flatten_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "events").select("event_id", decode.flattened(F.col("props")).alias("f"))
    return flat.select("event_id", F.explode("f.lines").alias("line"), "f.total_keys", "f.max_depth", "f.truncated")


@query("""SELECT event_id, list_filter([CASE WHEN event_id % 9 = 5 THEN 'W_LARGE_FILE' END, CASE WHEN event_id % 11 = 10 THEN 'E_SECURITY_BAD_EXTENSION' WHEN t IS NULL THEN 'E_PARSE_CORRUPT' WHEN t = '' THEN 'E_PARSE_EMPTY' WHEN length(t) > 400 THEN 'E_SECURITY_TOO_LARGE'
    WHEN NOT json_valid(t) THEN 'E_SECURITY_INVALID_JSON' WHEN event_id % 9 = 3 THEN 'E_SECURITY_NESTING_BOMB' END], lambda x: x IS NOT NULL AND (x <> 'W_LARGE_FILE' OR event_id % 11 <> 10)) AS codes
  FROM (SELECT event_id, CASE event_id % 9 WHEN 1 THEN '' WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 3 THEN repeat('[', 101) || repeat(']', 101) WHEN 4 THEN repeat('[', 100) || repeat(']', 100) WHEN 5 THEN '["' || repeat('[', 300) || '"]' WHEN 6 THEN repeat('1', 401) WHEN 8 THEN ' ' WHEN 7 THEN NULL ELSE props END AS t FROM events)""")
def p1_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.expr("CASE event_id % 9 WHEN 1 THEN '' WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 3 THEN repeat('[', 101) || repeat(']', 101) WHEN 4 THEN repeat('[', 100) || repeat(']', 100) WHEN 5 THEN '[\"' || repeat('[', 300) || '\"]' WHEN 6 THEN repeat('1', 401) WHEN 8 THEN ' ' WHEN 7 THEN NULL ELSE props END")
    path = F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 11 == 10, ".txt").otherwise(".JSON"))
    return table(spark, sf_dir, "events").select("event_id", files.scan_json(broken, path, largest=400, warn_at=210).alias("codes"))


XML_PARTS = {1: "<!entity x \"y\"><a/>", 2: "<!DOCTYPE a [ <!ELEMENT a ANY> ]><a/>", 3: "", 4: "<a><b></a>", 6: "<!DOCTYPE a><a><b/><b/><b/></a>", 7: "  "}


@query("""SELECT page_id, list_filter([CASE page_id % 9 WHEN 1 THEN 'E_SECURITY_ENTITY_DECLARATION' WHEN 2 THEN 'E_SECURITY_ENTITY_DECLARATION' WHEN 3 THEN 'E_PARSE_EMPTY' WHEN 4 THEN 'E_SECURITY_INVALID_XML' WHEN 5 THEN 'E_SECURITY_DEPTH_BOMB'
  WHEN 6 THEN 'W_TRUNCATED' WHEN 7 THEN 'E_SECURITY_INVALID_XML' END], lambda x: x IS NOT NULL) AS codes FROM pages""")
def p2_xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace(F.regexp_replace("html", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text_ = F.when(F.col("page_id") % 9 == 5, F.expr("repeat('<a>', 101) || repeat('</a>', 101)"))
    for k, part in XML_PARTS.items():
        text_ = text_.when(F.col("page_id") % 9 == k, part)
    text_ = text_.otherwise(F.concat(F.lit("<p><q>"), escaped, F.lit("</q></p>")))
    return table(spark, sf_dir, "pages").select("page_id", files.scan_xml(text_, most=3).alias("codes"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 'E_SECURITY_BAD_EXTENSION' WHEN doc_id % 20 = 10 THEN 'E_SECURITY_BAD_MAGIC' WHEN doc_id % 100 = 20 THEN 'E_PARSE_EMPTY' END AS code FROM documents""")
def p3_p7_magic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(f"doc_id || '.' || {EXT}"))
    content = F.expr("CASE WHEN doc_id % 100 = 20 THEN unhex('') WHEN doc_id % 20 = 0 THEN encode('%PDF-1.7' || text, 'UTF-8') ELSE encode(text, 'UTF-8') END")
    return docs.select("doc_id", files.scan(content, F.col("path"), "pdf").alias("code"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN ['E_PARSE_EMPTY'] ELSE []::VARCHAR[] END AS fatal_codes,
  CASE WHEN value > 10 THEN ['W_LARGE', 'W_SLOW'] WHEN event_type = 'error' OR event_type = 'click' THEN ['W_SLOW'] ELSE []::VARCHAR[] END AS warning_codes FROM events""")
def p8_p9_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    first = F.when(F.col("value") > 10, F.array(F.lit("W_LARGE"), F.lit("W_SLOW"))).otherwise(none)
    second = F.when(F.col("event_type") == "error", F.array(F.lit("E_PARSE_EMPTY"), F.lit("W_SLOW"))).when(F.col("event_type") == "click", F.array(F.lit("W_SLOW"))).otherwise(none)
    merged = table(spark, sf_dir, "events").withColumn("codes", text.merge_codes(first, second))
    return merged.select("event_id", text.fatal(F.col("codes")).alias("fatal_codes"), text.warnings(F.col("codes")).alias("warning_codes"))


MESSAGES = ["Request Timed Out while EMBEDDING", "vector store timeout", "timeout", "Embed: connect failed", "Qdrant connection lost", "cannot connect", "Connection refused by collection x", "refused", "oops"]


@query(f"""WITH m AS (SELECT event_id, lower(({MESSAGES!r})[event_id % {len(MESSAGES)} + 1]) AS m FROM events),
  k AS (SELECT *, CASE WHEN m LIKE '%embed%' THEN 'EMBED' WHEN m LIKE '%vector%' OR m LIKE '%qdrant%' OR m LIKE '%collection%' THEN 'VECTOR' ELSE 'DB' END AS kind FROM m)
  SELECT event_id, CASE WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'E_BACKEND_' || kind || '_TIMEOUT' WHEN m LIKE '%connect%' THEN 'E_BACKEND_' || kind || '_CONNECT' ELSE 'E_PROCESS_SCHEMA_GEN' END AS code FROM k""")
def p10_backend_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.backend_error(message).alias("code"))


#: Mail addresses, social security numbers and card numbers. The last begins and ends in a digit: engines differ in what a word
#: boundary is beside a letter that isn't ASCII, so none may stand between a separator and such a letter.
REDACT = ["[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "\\b\\d{3}-\\d{2}-\\d{4}\\b", "\\b\\d(?:[ -]?\\d){12,15}\\b"]


@query(f"""SELECT doc_id, r AS text, (length(r) - length(replace(r, '[REDACTED]', ''))) // 10 AS n FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(text, '{REDACT[0]}', '[REDACTED]', 'g'), '{REDACT[1]}', '[REDACTED]', 'g'), '{REDACT[2]}', '[REDACTED]', 'g') AS r FROM documents)""")
def p12_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text"), REDACT).alias("text"))
    return done.withColumn("n", ((F.length("text") - F.length(F.replace("text", F.lit("[REDACTED]"), F.lit("")))) / 10).cast("long"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z]+ [a-z]*n[a-z]*') AS ok, NULL::BOOLEAN AS broken FROM part")
def p13_regex_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.matches(F.col("p_name"), "[a-z]+ [a-z]*n[a-z]*").alias("ok"), text.matches(F.col("p_name"), "(").alias("broken"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN 'narrative' WHEN len(list_filter(l, lambda x: contains(x, '|'))) > len(l) / 2 THEN 'table'
  WHEN len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(?:[-*]|\\d+\\.)\\s+'))) > len(l) / 2 THEN 'list'
  WHEN len(list_filter(l, lambda x: regexp_matches(x, '\\[\\s*[xX ]?\\s*\\]|_{3,}'))) > len(l) / 3 THEN 'form_field' ELSE 'narrative' END AS content_type
  FROM (SELECT doc_id, trim(text) AS t, string_split(trim(text), chr(10)) AS l FROM documents)""")
def c10_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_type(F.col("text")).alias("content_type"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'eng' END AS ocr_lang FROM documents""")
def c14_ocr_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.ocr_code(F.concat("lang", F.lit("-XX"))).alias("ocr_lang"))


@query(f"""WITH w AS (SELECT doc_id, length(text) AS n, list_transform(string_split(lower(text), ' '), lambda x: trim(x, '.,' || chr(10))) AS l FROM documents), s AS (
  SELECT doc_id, n, {", ".join(f"len(list_filter(l, lambda x: list_contains({v!r}, x))) AS s_{k}" for k, v in text.STOPWORDS.items())} FROM w)
  SELECT doc_id, CASE WHEN n = 0 THEN 'en' WHEN n < 10 THEN 'en' WHEN greatest(s_en, s_de, s_fr, s_es) = 0 THEN 'en' WHEN s_de > s_en AND s_de >= s_fr AND s_de >= s_es THEN 'de'
   WHEN s_fr > s_en AND s_fr > s_de AND s_fr >= s_es THEN 'fr' WHEN s_es > s_en AND s_es > s_de AND s_es > s_fr THEN 'es' ELSE 'en' END AS language,
   CASE WHEN n = 0 THEN 1.0 WHEN n < 10 THEN 0.5 WHEN greatest(s_en, s_de, s_fr, s_es) = 0 THEN 0.0
   ELSE round(greatest(s_en, s_de, s_fr, s_es) / (s_en + s_de + s_fr + s_es), 9) END::DOUBLE AS confidence FROM s""")
def c13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("l"))
    return found.select("doc_id", "l.language", F.round("l.confidence", 9).alias("confidence"))


def _greedy_sql(size: int, overlap: int, units: str, glue: str) -> str:
    """Greedy chunks of list `l` in `units` (doc_id, l, c: word counts), walked line by line."""
    return f"""
WITH RECURSIVE {units},
walk(doc_id, i, first, total, a, b, single) AS (
  SELECT doc_id, 0, 1, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false FROM u
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN n > {size} THEN i + 2 WHEN flush THEN back ELSE first END,
    CASE WHEN n > {size} THEN 0 WHEN flush THEN coalesce(list_sum(c[back:i]), 0)::BIGINT + n ELSE total + n END,
    CASE WHEN (n > {size} AND first <= i) OR flush THEN first END, CASE WHEN (n > {size} AND first <= i) OR flush THEN i END, n > {size}
  FROM (SELECT w.*, u.c, u.c[w.i + 1] AS n, (u.c[w.i + 1] <= {size} AND w.total + u.c[w.i + 1] > {size} AND w.first <= w.i) AS flush,
      coalesce(list_min(list_filter(range(w.first, w.i + 1), lambda j: list_sum(u.c[j:w.i]) <= {overlap})), w.i + 1) AS back
    FROM walk w JOIN u USING (doc_id) WHERE w.i < len(u.c))
), cut AS (
  SELECT doc_id, a, b, 0 AS k, i FROM walk WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, i, i, 1, i FROM walk WHERE single
  UNION ALL SELECT w.doc_id, first, i, 2, i + 1 FROM walk w JOIN u USING (doc_id) WHERE w.i = len(u.c) AND first <= i
), chunk AS (
  SELECT cut.doc_id, row_number() OVER (PARTITION BY cut.doc_id ORDER BY cut.i, k) - 1 AS chunk_index, array_to_string(l[a:b], {glue}) AS chunk FROM cut JOIN u USING (doc_id)
)"""


LINES = f"u AS (SELECT doc_id, source, string_split(text, chr(10)) AS l, list_transform(string_split(text, chr(10)), lambda x: {WORDS.format('x')})::BIGINT[] AS c, text FROM documents WHERE text <> '')"
UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || translate(substr({0}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
SHA1 = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0}))"


@query(_greedy_sql(128, 32, LINES, "chr(10)") + f""", keyed AS (SELECT chunk.*, {KEY.replace("text", "u.text")} AS k FROM chunk JOIN u USING (doc_id)),
  named AS (SELECT *, {SHA1.format("k || ':' || chunk_index::VARCHAR")} AS d FROM keyed)
  SELECT doc_id, chunk_index::INTEGER AS chunk_index, chunk, sha256(chunk) AS chunk_hash, {UUID.format("d")} AS id FROM named""")
def h1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.line_chunks(keyed_documents(spark, sf_dir).select("doc_id", "ingest_key", "text"), size=128, overlap=32)
    return chunking.with_ids(chunks, "ingest_key").select("doc_id", "chunk_index", "chunk", "chunk_hash", "id")


PARAGRAPHS = f"""p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
  u AS (SELECT doc_id, l, list_transform(l, lambda x: {WORDS.format('x')})::BIGINT[] AS c FROM (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN ({WORDS.format('x')}) > 64
    THEN list_filter(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), lambda y: y <> '') ELSE [x] END)) AS l FROM p) WHERE len(l) > 0)"""


@query(_greedy_sql(64, 16, PARAGRAPHS, "chr(10) || chr(10)") + " SELECT doc_id, chunk_index::INTEGER AS chunk_index, chunk FROM chunk")
def h2_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return chunking.paragraph_chunks(docs, size=64, overlap=16)


@query()
def h3_h7_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.heading_aware_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::INTEGER AS tokens FROM documents")
def h8_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH k AS (SELECT doc_id, {KEY} AS k, sha256(text) AS h FROM documents), d AS (SELECT *, {SHA1.format("k || ':' || h")} AS a, {SHA1.format("k || ':0'")} AS b FROM k)
  SELECT doc_id, {UUID.format("a")} AS by_hash, {UUID.format("b")} AS by_index, substr(k, 1, 16) || '_' || substr(h, 1, 16) AS short FROM d""")
def h9_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, hash_ = keyed_documents(spark, sf_dir), ids.content_hash(F.col("text"))
    key = F.col("ingest_key")
    return docs.select("doc_id", ids.chunk_id_by_hash(key, hash_).alias("by_hash"), ids.chunk_id_by_index(key, F.lit(0)).alias("by_index"), ids.chunk_id_short(key, hash_).alias("short"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' (' || p_name || ')!'), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM part""")
def f1_clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_name(F.expr("p_brand || ' (' || p_name || ')!'")).alias("name"))


def _ocr_clean_sql() -> str:
    """The same without look-around and back references: stray letters by splitting at spaces, marks one after the other."""
    raw = "replace(replace(replace(text, '. ', '-' || chr(10)), '!', '!!!!'), ',', ' x ,,,,' || chr(13))"
    t = f"nfc_normalize(regexp_replace({raw}, '([a-zA-Z])-\\r?\\n([a-zA-Z])', '\\1\\2', 'g'))"
    t = f"regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    stray = "regexp_full_match(w, '[b-zB-HJ-Z]')"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda w: CASE WHEN {stray} THEN '' ELSE w END), ' ')), chr(10))"
    for code in [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]:
        once = "chr(92) || chr(92)" if code == 0x5C else f"chr({code})"
        t = f"regexp_replace({t}, '[\\x{code:02x}]{{4,}}', {once}, 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' {{2,}}', ' ', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')"
    return f"SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\s]') THEN {t} ELSE '' END AS text FROM documents"


@query(_ocr_clean_sql())
def f2_ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("replace(replace(replace(text, '. ', '-\\n'), '!', '!!!!'), ',', concat(' x ,,,,', chr(13))) AS text"))
    return docs.select("doc_id", text.ocr_clean(F.col("text")).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, make_timestamp(epoch_us(TIMESTAMP '1899-12-30') + (round((36000 + l_quantity + l_tax) * 86400)::BIGINT * 1000000)) AS at FROM lineitem""")
def f13_serial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = text.serial_date(36000 + F.col("l_quantity") + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", at.alias("at"))


MARKS = [" Yes", "x", "TRUE ", "1", "on", "checked", "off", "", "maybe"]
DAYS = ["yyyy-MM-dd", "MM/dd/yyyy", "d/M/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd "]
_SPELT = ["%Y-%m-%d", "%m/%d/%Y", "%-d/%-m/%Y", "%Y-%m-%dT%H:%M:%S"]


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS num,
  CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 7 < 4 THEN CASE o_orderkey % 7 {" ".join(f"WHEN {i} THEN strftime(o_orderdate, {form!r})" for i, form in enumerate(_SPELT))} END END AS day, o_orderkey % 9 < 4 AS checked,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN o_totalprice END AS w_number,
  CASE WHEN o_orderkey % 4 IN (1, 2) THEN lower(({MARKS!r})[o_orderkey % 9 + 1]) IN ('yes', 'on', 'true', '1') WHEN o_orderkey % 4 = 3 THEN trim(({MARKS!r})[o_orderkey % 9 + 1]) <> '' END AS w_checked,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'n/a' END AS w_text FROM orders""")
def f4_f5_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.lit("n/a")
    for i, form in enumerate(DAYS):
        day = F.when(key % 7 == i, F.date_format("o_orderdate", form)).otherwise(day)
    raw = F.when(key % 3 == 0, F.col("o_totalprice").cast("string")).when(key % 3 == 1, day).otherwise("n/a")
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (key % len(MARKS) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("number", "checkbox", "radio", "signature"))), (key % 4 + 1).cast("int"))
    widget = text.widget_value(F.when(kind != "number", mark).when(key % 3 == 0, F.col("o_totalprice").cast("string")).otherwise("n/a"), kind)
    return orders.select(
        "o_orderkey", text.coerce_number(F.when(key % 3 == 0, raw)).alias("num"), text.coerce_date(F.when(key % 3 == 1, raw)).alias("day"), text.coerce_checkbox(mark).alias("checked"),
        widget["number"].alias("w_number"), widget["checked"].alias("w_checked"), widget["text"].alias("w_text"),
    )


HTML_TEXT = r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!(?i:doctype)[^>]*>', '', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?i)<br\b[^>]*>|</?p\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM pages"""


@query(HTML_TEXT)
def t9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query()
def t9_html_text_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", decode.html_to_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, (len(l) + 1)::INTEGER AS elements, false AS fallback, array_to_string(list_concat(['doc [id=' || doc_id || ']'],
  list_transform(list_filter(list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: 'p: ' || x)), chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def t8_xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<doc id='"), F.col("doc_id").cast("string"), F.lit("'><p>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></doc>"))
    found = table(spark, sf_dir, "documents").select("doc_id", decode.xml_lines(xml).alias("x"))
    return found.select("doc_id", F.col("x.total_elements").alias("elements"), F.col("x.fallback_used").alias("fallback"), F.array_join("x.lines", "\n").alias("text"))


@query("""SELECT conv_id, 'From: ' || min(role) || '@example.org' || chr(10) || 'Subject: conversation ' || conv_id || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id""")
def t10_email_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    mails = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("body"), F.min("role").alias("role"))
    none = F.lit(None).cast("string")
    return mails.select("conv_id", decode.email_text(F.expr("role || '@example.org'"), none, F.lit(""), none, F.expr("'conversation ' || conv_id"), F.col("body")).alias("text"))


@query("""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS chunk_index FROM conversations""")
def w14_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_index(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "chunk_index")


@query(f"SELECT count(DISTINCT {KEY})::BIGINT AS kept, count(*)::BIGINT AS n FROM (SELECT doc_id, text, source FROM documents UNION ALL SELECT doc_id, text, source FROM documents WHERE doc_id % 4 = 0)")
def u4_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_documents(spark, sf_dir)
    twice = docs.unionByName(docs.filter("doc_id % 4 = 0")).select("ingest_key")
    return chunking.drop_known(twice).agg(F.count(F.lit(1)).alias("kept")).crossJoin(twice.agg(F.count(F.lit(1)).alias("n")))


@query("""WITH t AS (SELECT event_id, 'e/' || event_id || '.json' AS uri, CASE event_id % 5 WHEN 1 THEN '' WHEN 2 THEN '{' ELSE props END AS text FROM events),
  k AS (SELECT event_id, uri, text, CASE WHEN event_id % 5 IN (1, 2) THEN '' ELSE sha256(sha256(text) || '|' || uri || '|1') END AS ingest_key FROM t)
  SELECT uri, ingest_key, CASE event_id % 5 WHEN 1 THEN ['E_PARSE_EMPTY'] WHEN 2 THEN ['E_SECURITY_INVALID_JSON'] ELSE []::VARCHAR[] END AS errors, CASE WHEN ingest_key = '' THEN 0 ELSE 1 END::BIGINT AS n_chunks,
  CASE WHEN ingest_key <> '' THEN 1 END::INTEGER AS total, CASE WHEN ingest_key = '' THEN 0 ELSE 256 END::INTEGER AS dimension FROM k""")
def a15_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.expr("'e/' || event_id || '.json'").alias("uri"), F.expr("CASE event_id % 5 WHEN 1 THEN '' WHEN 2 THEN '{' ELSE props END").alias("text"))
    return chains.process(raw, "json").results.select("uri", "ingest_key", "errors", "n_chunks", "total", "dimension")


@query("""SELECT count(*)::BIGINT AS n_files, count_if(event_id % 5 IN (1, 2))::BIGINT AS n_failed, count_if(event_id % 5 NOT IN (1, 2))::BIGINT AS n_chunks FROM events""")
def a15_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.expr("'e/' || event_id || '.json'").alias("uri"), F.expr("CASE event_id % 5 WHEN 1 THEN '' WHEN 2 THEN '{' ELSE props END").alias("text"))
    return chains.run_totals(chains.process(raw, "json").results).select("n_files", "n_failed", "n_chunks")
