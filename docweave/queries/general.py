"""Queries of the general data-processing operators (problems 2 to 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import differ, drift, nested, rejects
from docweave.queries.canonical_sql import canonical_id, field_texts, leaf
from docweave.session import staged


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.element_rows(table(spark, sf, "doc_store"), ["row_id"], kind="coll")


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and documents of each flat table, named by its path, and its depth."""
    name = F.regexp_replace("child_path", r"(^|\.)[0-9]+", "$1[]")
    rows = nested.element_rows(table(spark, sf, "doc_store"), ["row_id"], kind="coll").select(name.alias("table_name"), "row_id")
    per_doc = rows.groupBy("table_name", "row_id").agg(F.count("*").alias("n"))
    depth = F.size(F.split("table_name", r"\[\]")) - 1
    return per_doc.groupBy("table_name").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_docs")).withColumn("depth", depth)


def p2_cargo(spark: SparkSession, sf: str) -> DataFrame:
    """One of the flat tables, with its link and two of its fields."""
    return nested.flat_table(table(spark, sf, "doc_store"), ["row_id"], "legs.[].cargo.[]", ["item", "qty"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_drift(table(spark, sf, "doc_store"), table(spark, sf, "export_files"))


def p3_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return drift.lifespans(drift.file_catalogue(table(spark, sf, "doc_store"), table(spark, sf, "export_files")))


def p3_unified(spark: SparkSession, sf: str) -> DataFrame:
    docs, files = table(spark, sf, "doc_store"), table(spark, sf, "export_files")
    catalogue = staged(drift.file_catalogue(docs, files, present=0), "catalogue")
    log = drift.schema_drift(docs, files, catalogue=catalogue)
    return drift.unified_table(docs, catalogue, staged(drift.file_aliases(log, files), "aliases"), ["row_id", "file", "coll"])


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    layouts = rejects.read_layouts(table(spark, sf, "import_layouts"))
    return rejects.judge_lines(table(spark, sf, "montyimport"), layouts, ["line_id", "file", "line_no", "layout"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected_rows(_judged(spark, sf), ["line_id"])


def p4_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records of all layouts, their values as one text in layout order."""
    values = F.transform("field_values", lambda x: F.coalesce(x, F.lit("<null>")))
    return _judged(spark, sf).where("reason IS NULL AND NOT is_header").select("line_id", "layout", F.concat_ws("|", values).alias("field_values"))


def p4_loans(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records of one layout, typed."""
    layouts = rejects.read_layouts(table(spark, sf, "import_layouts"))
    return rejects.valid_rows(_judged(spark, sf).where("layout = 'loans_csv'"), layouts["loans_csv"], ["line_id"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return differ.diff_copies(table(spark, sf, "flatfile_copy"), table(spark, sf, "sqlite_copy"))


def p5_summary(spark: SparkSession, sf: str) -> DataFrame:
    return differ.diff_summary(p5_found(spark, sf))


QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p2_cargo, p3_found, p3_lifespans, p3_unified, p4_found, p4_valid, p4_loans, p5_found, p5_summary)}

_P2 = r"""
SELECT row_id,
  regexp_replace(regexp_replace(up, '^\$\.?', ''), '\[(\d+)\]', '.\1', 'g') AS parent_path,
  regexp_replace(regexp_replace(fullkey, '^\$\.?', ''), '\[(\d+)\]', '.\1', 'g') AS child_path
FROM (
  SELECT d.row_id, t.fullkey, regexp_replace(t.fullkey, '(\.[^.\[\]]+)+(\[\d+\])+$', '') AS up
  FROM doc_store d, json_tree(CAST(d.v AS JSON)) t
  WHERE d.v IS NOT NULL AND t.type = 'OBJECT' AND t.fullkey LIKE '%]' AND NOT coalesce(starts_with(json_keys(t.value)[1], '$'), false)
)
"""

_P4 = r"""
WITH layouts AS (
  SELECT layout, any_value(fmt) AS fmt, any_value(delim) AS d, count(*) AS width,
    list(struct_pack(t := field_type, ok := null_ok, n := field_name) ORDER BY pos) AS fields
  FROM import_layouts GROUP BY layout
), lines AS (
  SELECT line_id, line_no, trim(raw_line, ' ' || chr(13)) AS s, layouts.* FROM montyimport JOIN layouts USING (layout)
), delimited AS (
  SELECT *, replace('d("([^"]|"")*"|[^"d]*)', 'd', d) AS one FROM lines WHERE fmt = 'delimited' AND line_no <> 1
), texts AS (
  SELECT *, list_transform(regexp_extract_all(d || s, one, 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END) AS got,
    regexp_full_match(d || s, '(' || one || ')+') AS quoted
  FROM delimited
), judged AS (
  SELECT line_id, layout, list_transform(list_zip(got, fields), lambda z: CASE WHEN z[1] <> '' OR z[2].t = 'string' THEN z[1] END) AS record, quoted, len(got) = width AS counted,
    len(list_filter(list_zip(got, fields), lambda z: NOT CASE
      WHEN z[1] = '' AND z[2].t <> 'string' THEN z[2].ok
      WHEN z[2].t = 'int' THEN regexp_full_match(z[1], '[+-]?[0-9]+') AND TRY_CAST(z[1] AS BIGINT) IS NOT NULL
      WHEN z[2].t = 'number' THEN regexp_full_match(z[1], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
      WHEN z[2].t = 'bool' THEN lower(z[1]) IN ('true', 'false')
      WHEN z[2].t = 'date' THEN regexp_full_match(z[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND z[1] >= '0001' AND TRY_CAST(z[1] AS DATE) IS NOT NULL
      WHEN z[2].t = 'oid' THEN regexp_full_match(z[1], '[0-9a-fA-F]{24}')
      ELSE true END)) = 0 AS valued
  FROM texts
), objects AS (
  SELECT *, CASE WHEN json_valid(s)
    -- stricter than json_valid: no comma before a bracket, no NaN or Infinity
    AND NOT regexp_matches(regexp_replace(s, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[}\]]|[NI]|nan|inf') THEN CAST(s AS JSON) END AS j FROM lines WHERE fmt = 'ndjson'
), values_ AS (
  SELECT *, list_transform(fields, lambda f: struct_pack(t := f.t, ok := f.ok, kind := coalesce(json_type(j, '$."' || f.n || '"'), 'NULL'),
      text := json_extract_string(j, '$."' || f.n || '"'), oid := json_extract_string(j, '$."' || f.n || '"."$oid"'), names := json_keys(j, '$."' || f.n || '"'))) AS got
  FROM objects
), both_ AS (
  SELECT * FROM judged UNION ALL
  SELECT line_id, layout, list_transform(got, lambda g: CASE WHEN g.t = 'oid' THEN g.oid ELSE g.text END), coalesce(json_type(j) = 'OBJECT', false), len(json_keys(j)) = width,
    len(list_filter(got, lambda g: NOT CASE
      WHEN g.kind = 'NULL' THEN g.ok
      WHEN g.t = 'int' THEN g.kind IN ('BIGINT', 'UBIGINT')
      WHEN g.t = 'number' THEN g.kind IN ('BIGINT', 'UBIGINT', 'DOUBLE')
      WHEN g.t = 'bool' THEN g.kind = 'BOOLEAN'
      WHEN g.t = 'oid' THEN g.names = ['$oid'] AND coalesce(regexp_full_match(g.oid, '[0-9a-fA-F]{24}'), false)
      WHEN g.t = 'date' THEN g.kind = 'VARCHAR' AND regexp_full_match(g.text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND g.text >= '0001' AND TRY_CAST(g.text AS DATE) IS NOT NULL
      ELSE g.kind = 'VARCHAR' END)) = 0
  FROM values_
)
"""
_P4_FOUND = f"""{_P4}
SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT counted THEN 'column_count' ELSE 'bad_value' END AS reason
FROM both_ WHERE NOT (quoted AND counted AND valued)
"""

_P5 = f"""
WITH ka AS (SELECT a_row AS r, coll, {canonical_id("_id")} AS c FROM flatfile_copy),
  kb AS (SELECT b_row AS r, coll, {canonical_id("_id")} AS c FROM sqlite_copy),
  fa AS ({field_texts("flatfile_copy", "a_row")}),
  fb AS ({field_texts("sqlite_copy", "b_row")}),
  met AS (SELECT ka.r AS a, kb.r AS b FROM ka JOIN kb ON ka.coll = kb.coll AND ka.c = kb.c)
SELECT r AS a_row, CAST(-1 AS BIGINT) AS b_row, '' AS field_name FROM ka WHERE r NOT IN (SELECT a FROM met)
UNION ALL SELECT -1, r, '' FROM kb WHERE r NOT IN (SELECT b FROM met)
UNION ALL SELECT coalesce(x.a, y.a), coalesce(x.b, y.b), coalesce(x.field, y.field)
FROM (SELECT met.a, met.b, fa.field, fa.c FROM met JOIN fa ON fa.r = met.a) x
FULL JOIN (SELECT met.a, met.b, fb.field, fb.c FROM met JOIN fb ON fb.r = met.b) y ON x.a = y.a AND x.field = y.field
WHERE x.c IS DISTINCT FROM y.c
"""

_VALUE = "(t.type = 'OBJECT' AND coalesce(starts_with(json_keys(t.value)[1], '$'), false))"
_CATALOGUE = f"""
WITH nodes AS (
  SELECT d.row_id, d.file, d.k, t.id, t.fullkey, t.type, t.value, replace(substr(regexp_replace(t.fullkey, '\\[\\d+\\]', '', 'g'), 3), '"', '') AS path,
    {leaf()} AS leaf, {_VALUE} AS is_value
  FROM doc_store d, json_tree(CAST(d.v AS JSON)) t WHERE d.v IS NOT NULL
), fields AS (
  SELECT *, CASE WHEN is_value THEN CASE json_keys(value)[1] WHEN '$numberDecimal' THEN 'decimal' WHEN '$date' THEN 'date' WHEN '$oid' THEN 'objectId' WHEN '$numberLong' THEN 'number' WHEN '$numberInt' THEN 'number' WHEN '$numberDouble' THEN 'number' ELSE json_keys(value)[1] END
    WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'bool' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'OBJECT' THEN 'object' WHEN type <> 'NULL' THEN 'number' END AS kind
  FROM nodes WHERE fullkey <> '$' AND fullkey NOT LIKE '%]' AND fullkey NOT LIKE '%][%' AND fullkey NOT LIKE '%."$%'
), sizes AS (SELECT file, count(*) AS n FROM doc_store WHERE v IS NOT NULL GROUP BY file),
present AS (SELECT file, path FROM fields JOIN sizes USING (file) GROUP BY file, path, n HAVING count(DISTINCT row_id) * 10 >= n),
kinds AS (
  SELECT file, path, kind FROM (SELECT file, path, kind, row_number() OVER (PARTITION BY file, path ORDER BY count(*) DESC, kind) AS r FROM fields WHERE kind IS NOT NULL GROUP BY file, path, kind) WHERE r = 1
), catalogue AS (SELECT feed, CAST(file_no AS BIGINT) AS file_no, file, path, kind FROM present LEFT JOIN kinds USING (file, path) JOIN export_files USING (file))
"""
_P3 = f"""{_CATALOGUE}
, steps AS (
  SELECT a.file AS old_file, b.file FROM (SELECT DISTINCT feed, file_no, file FROM catalogue) a JOIN (SELECT DISTINCT feed, file_no, file FROM catalogue) b ON a.feed = b.feed AND b.file_no = a.file_no + 1
), sides AS (
  SELECT s.file, s.old_file, c.path, true AS old, c.kind FROM steps s JOIN catalogue c ON c.file = s.old_file UNION ALL SELECT s.file, s.old_file, c.path, false, c.kind FROM steps s JOIN catalogue c ON c.file = s.file
), every AS (
  SELECT file, old_file, path, CASE WHEN bool_and(old) THEN 'removed' WHEN NOT bool_or(old) THEN 'added' ELSE 'retyped' END AS drift_kind
  FROM sides GROUP BY file, old_file, path HAVING count(*) = 1 OR count(DISTINCT kind) = 2
), changes AS (
  SELECT *, CASE WHEN path LIKE '%.%' THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END AS parent FROM every c
  WHERE NOT EXISTS (SELECT 1 FROM every u WHERE u.file = c.file AND starts_with(c.path, u.path || '.'))
), pairs AS (
  SELECT o.file, o.old_file, o.path AS old_path, n.path AS new_path FROM changes o JOIN changes n ON o.file = n.file AND o.parent = n.parent AND o.drift_kind = 'removed' AND n.drift_kind = 'added'
), wanted AS (SELECT old_file AS file, old_path AS path FROM pairs UNION SELECT file, new_path FROM pairs),
tops AS (SELECT row_id, file, k, path, fullkey FROM fields JOIN wanted USING (file, path) WHERE k IS NOT NULL),
held AS (
  SELECT file, path, k, held FROM (
    SELECT p.file, p.path, p.k, row_number() OVER (PARTITION BY p.file, p.path, p.k ORDER BY p.row_id) AS r,
      string_agg(regexp_replace(substr(n.fullkey, len(p.fullkey) + 1), '\\."\\$[a-zA-Z]+"', '', 'g') || '=' || n.leaf, ';' ORDER BY n.id) AS held
    FROM tops p JOIN nodes n ON n.row_id = p.row_id AND (n.fullkey = p.fullkey OR starts_with(n.fullkey, p.fullkey || '.') OR starts_with(n.fullkey, p.fullkey || '[')) AND NOT n.is_value
    GROUP BY p.file, p.path, p.k, p.row_id
  ) WHERE r = 1
), renamed AS (
  SELECT p.file, old_path, new_path FROM pairs p JOIN held a ON a.file = p.old_file AND a.path = p.old_path JOIN held b ON b.file = p.file AND b.path = p.new_path AND b.k = a.k
  GROUP BY p.file, old_path, new_path HAVING count(*) >= 5 AND count(*) FILTER (WHERE a.held = b.held) >= 0.9 * count(*)
)
SELECT file, 'renamed' AS drift_kind, old_path, new_path FROM renamed
UNION ALL SELECT file, drift_kind, CASE WHEN drift_kind = 'added' THEN '' ELSE path END, CASE WHEN drift_kind = 'removed' THEN '' ELSE path END FROM changes c
WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file = c.file AND (c.drift_kind = 'removed' AND r.old_path = c.path OR c.drift_kind = 'added' AND r.new_path = c.path))
"""

SQL: dict[str, str] = {
    "p3_found": _P3,
    "p3_lifespans": f"""{_CATALOGUE}
SELECT feed, path, kind AS type, min(file_no) AS first_no, max(file_no) AS last_no FROM (
  SELECT *, file_no - row_number() OVER (PARTITION BY feed, path, kind ORDER BY file_no) AS island FROM catalogue) GROUP BY feed, path, kind, island
""",
    "p2_found": _P2,
    "p2_tables": f"""
SELECT table_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_docs, CAST(len(string_split(table_name, '[]')) - 1 AS INTEGER) AS depth
FROM (SELECT regexp_replace(child_path, '(^|\\.)[0-9]+', '\\1[]', 'g') AS table_name, row_id, count(*) AS n FROM ({_P2}) GROUP BY 1, 2) GROUP BY 1
""",
    "p2_cargo": f"""
SELECT row_id, parent_path, child_path, json_extract_string(value, '$.item') AS item, json_extract_string(value, '$.qty') AS qty
FROM ({_P2.replace("SELECT row_id,", "SELECT row_id, value,", 1).replace("SELECT d.row_id, t.fullkey,", "SELECT d.row_id, t.value, t.fullkey,")})
WHERE regexp_full_match(child_path, 'legs\\.[0-9]+\\.cargo\\.[0-9]+')
""",
    "p4_found": _P4_FOUND,
    "p4_valid": f"""{_P4}
SELECT line_id, layout, array_to_string(list_transform(record, lambda x: coalesce(x, '<null>')), '|') AS field_values FROM both_ WHERE quoted AND counted AND valued
""",
    "p4_loans": f"""{_P4}
SELECT line_id, CAST(record[1] AS BIGINT) AS _id, record[2] AS item, CAST(record[3] AS DATE) AS lent_on, CAST(record[4] AS DATE) AS back_on, CAST(record[5] AS DOUBLE) AS fine, CAST(lower(record[6]) AS BOOLEAN) AS lost
FROM both_ WHERE quoted AND counted AND valued AND layout = 'loans_csv'
""",
    "p5_found": _P5,
    "p5_summary": f"""
SELECT CASE WHEN b_row = -1 THEN 'only_a' WHEN a_row = -1 THEN 'only_b' ELSE 'field' END AS kind, field_name, count(*) AS documents
FROM ({_P5}) GROUP BY 1, 2
""",
}
