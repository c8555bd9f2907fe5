"""Queries of the parsers, over texts put together from the supply tables in the form models write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import SPACE
from loomspan.operators import parsing as P
from loomspan.sources.tables import table

CATEGORIES = ("person", "product", "place", "organization")

_HEAD = lambda name: f"CASE p_partkey % 3 WHEN 0 THEN '=== {name.title()} ===' WHEN 1 THEN '## {name}' ELSE '{name}:' END"
_ROW = "concat_ws(' | ', p_name, CASE WHEN p_size % 4 > 0 THEN p_brand END, CASE WHEN p_size % 4 > 1 THEN concat(' ', p_type, ' ') END, CASE WHEN p_size % 4 > 2 THEN 'over' END)"
# Texts of many shapes, in an expression that Spark and the twins' SQL both read: three kinds of headers, unknown ones, fences, short and long rows, sections twice, placeholders, line ends of either kind.
_TEXT = "CASE WHEN p_partkey % 7 = 0 THEN replace(x, chr(10), concat(chr(13), chr(10))) ELSE x END"
_LINES = f"""concat_ws(chr(10),
  'preamble', CASE WHEN p_size % 2 = 0 THEN '```text' END, {_HEAD('FORMAT')}, CASE p_size % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'Tutorial' ELSE concat('Review', chr(10), '  Embed ') END, CASE WHEN p_size % 2 = 0 THEN '```' END,
  {_HEAD('EPISODE')}, CASE WHEN p_size % 3 = 0 THEN 'None' WHEN p_size % 3 = 1 THEN p_brand ELSE concat(p_brand, ' | ', CAST(p_size AS STRING), ' | rest') END,
  {_HEAD('SPEAKERS')}, {_ROW}, '', 'NOTES:', {_HEAD('ENTITIES')}, upper(p_name), concat(p_brand, ' | ', CASE WHEN p_size % 5 = 0 THEN 'thing |' ELSE 'place' END), {_ROW},
  CASE WHEN p_size % 2 = 1 THEN concat({_HEAD('CONCEPTS')}, chr(10), p_type, ' | ', p_name, chr(10), '=== OTHER THINGS ===', chr(10), 'lost | words') END,
  {_HEAD('SOURCES')}, 'old', {_HEAD('RELATIONSHIPS')}, concat(p_name, ' | ', p_brand), {_HEAD('SOURCES')}, concat(p_type, ' | clue | ', CASE WHEN p_size % 2 = 0 THEN 'None' ELSE 'http://x.test' END), 'n/a', CASE WHEN p_size % 6 = 0 THEN concat(p_brand, ' | ', ' | http://y.test') END)"""
_EVAL = """concat('COVERAGE: ', CASE p_size % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'partial' ELSE 'unsure' END, chr(10), 'GAPS:', chr(10), '- ', p_name, chr(10), p_type, chr(10), CASE WHEN p_partkey % 2 = 0 THEN concat('SUPPORTED:', chr(10), '- ', p_brand, chr(10)) ELSE '' END,
  'VALUE: ', CASE WHEN p_size % 4 = 0 THEN 'insufficient' ELSE concat('Insight: ', cast(p_size % 5 + 1 AS STRING), CASE WHEN p_size % 3 = 0 THEN '' ELSE ', quality: 3' END, ', delivery: ', cast(p_size % 9 AS STRING)) END,
  chr(10), 'VERDICT: ', CASE p_size % 4 WHEN 0 THEN 'Discard it' WHEN 1 THEN 'score' WHEN 2 THEN 'need_transcript, do not score' ELSE 'unclear' END)"""


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part")
    return rows.withColumn("x", F.expr(_LINES)).select("p_partkey", "p_size", F.expr(_TEXT).alias("text"), F.expr(_EVAL).alias("judged"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).select("p_partkey", "p_size", P.extraction(F.col("text")).alias("extraction"))


def section_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of each text."""
    return _parts(spark, folder).select("p_partkey", P.sections(F.col("text")).alias("s")).select("p_partkey", F.explode("s").alias("section", "body"))


def pipe_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the entity sections."""
    return _parsed(spark, folder).select("p_partkey", F.posexplode("extraction.entities").alias("i", "e")).select("p_partkey", "i", "e.name", "e.category", "e.aliases")


def extraction_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Whole extractions: formats, episode, sources and whether these are traced."""
    e = F.col("extraction")
    return _parsed(spark, folder).select(
        "p_partkey", F.array_join(e["formats"], ",").alias("formats"), e["episode"]["series"].alias("series"), e["episode"]["episode"].alias("episode"),
        F.size(e["sources"]).alias("sources"), F.get(e["sources"], 0)["url"].alias("url"), P.traced(e["formats"], e["sources"]).alias("traced"),
    )


def extraction_text(spark: SparkSession, folder: str) -> DataFrame:
    """Extractions written as text again."""
    return _parsed(spark, folder).select("p_partkey", P.rendered(F.col("extraction")).alias("text"))


def prefixed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values by prefix."""
    return _parts(spark, folder).select("p_partkey", F.explode(P.prefixed(F.col("judged"))).alias("k", "v"))


def evaluation_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations as typed columns."""
    rows = _parts(spark, folder).select("p_partkey", P.evaluation(F.col("judged")).alias("e"))
    return rows.select("p_partkey", "e.coverage", F.array_join("e.gaps", "|").alias("gaps"), "e.insight", "e.novelty", "e.quality", "e.verdict")


def validation_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What is odd about the extractions."""
    rows = _parsed(spark, folder).withColumn("offsets", F.array(F.lit(0), F.col("p_size") * 10, F.lit(100))).withColumn("duration", F.lit(300))
    return P.warnings(rows, "p_partkey", CATEGORIES)


QUERIES = {f.__name__: f for f in (section_parse, pipe_rows, extraction_assembly, extraction_text, prefixed_values, evaluation_parse, validation_warnings)}

_ST = lambda e: f"regexp_replace({e}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_NAME = lambda e: f"replace(upper({_ST(e)}), ' ', '_')"
_OTHER = r"coalesce(nullif(regexp_extract(bare, '^#{2,6}\s*([A-Z][A-Z_ ]*?)\s*:?$', 1), ''), regexp_extract(bare, '^([A-Z][A-Z_ ]*?):$', 1))"
_PARSED = rf"""t AS (SELECT p_partkey, p_size, {_TEXT} AS text, {_EVAL} AS judged FROM (SELECT *, {_LINES} AS x FROM part)),
l AS (SELECT p_partkey, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT p_partkey, regexp_split_to_array(text, '\r?\n') AS ls FROM t)),
b AS (SELECT *, {_ST("line")} AS bare FROM l WHERE NOT starts_with({_ST("line")}, '```')),
h AS (SELECT *, CASE WHEN regexp_matches(bare, '^===\s*(.+?)\s*===$') THEN {_NAME(r"regexp_extract(bare, '^===\s*(.+?)\s*===$', 1)")} WHEN {_NAME(_OTHER)} IN {P.SECTIONS} THEN {_NAME(_OTHER)} END AS name FROM b),
s AS (SELECT *, count(name) OVER (PARTITION BY p_partkey ORDER BY n) AS k FROM h),
g0 AS (SELECT p_partkey, k, max(name) AS section, {_ST("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (name IS NULL), '')")} AS body FROM s WHERE k > 0 GROUP BY p_partkey, k),
g AS (SELECT p_partkey, section, body FROM g0 QUALIFY row_number() OVER (PARTITION BY p_partkey, section ORDER BY k DESC) = 1),
u AS (SELECT p_partkey, section, generate_subscripts(bl, 1) AS n, unnest(bl) AS line FROM (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_ST("x")}), lambda x: x <> '') AS bl FROM g)),
r AS (SELECT p_partkey, section, n, list_transform(string_split(line, ' | '), lambda x: {_ST("x")}) AS f FROM u),
en AS (SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY n) - 1)::INTEGER AS i, f[1] AS name, regexp_replace(coalesce(f[2], ''), '^[ |]+|[ |]+$', '', 'g') AS category, coalesce(f[3], '') AS aliases FROM r WHERE section = 'ENTITIES'),
so AS (SELECT p_partkey, n, f[1] AS description, coalesce(f[2], '') AS clues, CASE WHEN lower(coalesce(f[3], '')) NOT IN ('', 'none') THEN f[3] END AS url FROM r WHERE section = 'SOURCES' AND lower(f[1]) NOT IN ('none', 'n/a', '-')),
fo AS (SELECT p_partkey, list(lower(line) ORDER BY n) AS formats FROM u WHERE section = 'FORMAT' GROUP BY 1),
ep AS (SELECT p_partkey, string_split(body, ' | ') AS p FROM g WHERE section = 'EPISODE' AND body <> '' AND lower(body) <> 'none'),
e1 AS (SELECT p_partkey, {_ST("p[1]")} AS series, {_ST("p[2]")} AS episode FROM ep WHERE p[1] <> ''),
ss AS (SELECT p_partkey, count(*)::INTEGER AS sources, list(url ORDER BY n)[1] AS url, count(url) AS urls FROM so GROUP BY 1),
tx AS (SELECT p_partkey, section, string_agg(line, chr(10) ORDER BY n) AS rows FROM (
    SELECT p_partkey, section, n, array_to_string(list_transform(range(1, CASE section WHEN 'CONCEPTS' THEN 3 WHEN 'RELATIONSHIPS' THEN 3 ELSE 4 END), lambda j: coalesce(f[j], '')), ' | ') AS line FROM r WHERE section IN ('SPEAKERS', 'CONCEPTS', 'RELATIONSHIPS')
    UNION ALL SELECT p_partkey, 'ENTITIES', i, concat_ws(' | ', name, category, aliases) FROM en UNION ALL SELECT p_partkey, 'SOURCES', n, concat_ws(' | ', description, clues, coalesce(url, 'none')) FROM so) GROUP BY ALL),
j0 AS (SELECT p_partkey, p_size, chr(10) || judged AS j FROM t)"""
_PART = lambda label: rf"regexp_extract(split_part(j, chr(10) || '{label}:', 2), '^[ \t]*((?s:.*?))(?:\n(?:COVERAGE|GAPS|SUPPORTED|VALUE|VERDICT):|$)', 1)"
_EVALUATED = rf"""ev AS (SELECT p_partkey, lower({_ST(_PART("COVERAGE"))}) AS c, {_PART("GAPS")} AS g, lower({_PART("VALUE")}) AS v, lower({_ST(_PART("VERDICT"))}) AS d FROM j0)"""
_GRADE = lambda k: rf"TRY_CAST(CASE WHEN NOT contains(v, 'insufficient') THEN nullif(regexp_extract(v, '{k}:\s*(\d)', 1), '') END AS INTEGER)"
ORACLE = {
    "section_parse": f"WITH {_PARSED} SELECT p_partkey, section, body FROM g",
    "pipe_rows": f"WITH {_PARSED} SELECT p_partkey, i, name, category, aliases FROM en",
    "extraction_assembly": f"""WITH {_PARSED} SELECT t.p_partkey, array_to_string(coalesce(formats, []), ',') AS formats, series, episode, coalesce(sources, 0)::INTEGER AS sources, url,
  list_has_any(coalesce(formats, []), {list(P.TRACED)!r}) OR coalesce(sources > 0 AND urls = 0, false) AS traced FROM t LEFT JOIN fo USING (p_partkey) LEFT JOIN e1 USING (p_partkey) LEFT JOIN ss USING (p_partkey)""",
    "extraction_text": f"""WITH {_PARSED}, x AS (SELECT p_partkey, map_from_entries(list((section, rows))) AS m FROM tx GROUP BY 1)
SELECT t.p_partkey, 'FORMAT:' || chr(10) || array_to_string(coalesce(formats, []), chr(10)) || chr(10) || chr(10) || 'EPISODE:' || chr(10) || coalesce(series || ': ' || coalesce(episode, ''), 'none')
  || {" || ".join(f"chr(10) || chr(10) || '{n}:' || chr(10) || coalesce(m['{n}'], '')" for n in P.FIELDS)} AS text FROM t LEFT JOIN fo USING (p_partkey) LEFT JOIN e1 USING (p_partkey) LEFT JOIN x USING (p_partkey)""",
    "prefixed_values": rf"""WITH {_PARSED}, p AS (SELECT p_partkey, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT p_partkey, string_split(judged, chr(10)) AS ls FROM t)),
q AS (SELECT p_partkey, n, lower(regexp_extract({_ST("line")}, '^([A-Z_]+):', 1)) AS k, {_ST(f"regexp_replace({_ST('line')}, '^[A-Z_]+:', '')")} AS v FROM p WHERE regexp_matches({_ST("line")}, '^[A-Z_]+:'))
SELECT p_partkey, k, v FROM q QUALIFY row_number() OVER (PARTITION BY p_partkey, k ORDER BY n DESC) = 1""",
    "evaluation_parse": rf"""WITH {_PARSED}, {_EVALUATED} SELECT p_partkey, CASE WHEN c IN ('full', 'partial', 'minimal') THEN c ELSE 'minimal' END AS coverage,
  array_to_string(list_transform(list_filter(list_transform(string_split(g, chr(10)), lambda x: {_ST("x")}), lambda x: x <> ''), lambda x: {_ST("regexp_replace(x, '^- ', '')")}), '|') AS gaps,
  {_GRADE("insight")} AS insight, {_GRADE("novelty")} AS novelty, {_GRADE("quality")} AS quality, CASE WHEN contains(d, 'discard') THEN 'discard' WHEN contains(d, 'score') THEN 'score' ELSE 'need_transcript' END AS verdict FROM ev""",
    "validation_warnings": f"""WITH {_PARSED}, o AS (SELECT p_partkey, p_size, unnest([0, p_size * 10, 100]) AS x, unnest([NULL, 0, p_size * 10]) AS before FROM t)
SELECT p_partkey, 'speaker not among entities: ' || f[1] AS warning FROM r WHERE section = 'SPEAKERS' AND NOT EXISTS (SELECT 1 FROM en WHERE en.p_partkey = r.p_partkey AND lower(en.name) = lower(r.f[1]))
UNION ALL SELECT p_partkey, 'unknown category: ' || category FROM en WHERE lower(category) NOT IN {CATEGORIES}
UNION ALL SELECT p_partkey, 'not ascending: ' || x FROM o WHERE x < before UNION ALL SELECT p_partkey, 'beyond the end: ' || x FROM o WHERE x > 300""",
}
