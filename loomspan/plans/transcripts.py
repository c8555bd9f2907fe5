"""Queries of chapters, headings and transcript chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.providers import asked, profile_of
from loomspan.functions.text import SPACE, timestamps
from loomspan.functions.values import duration_seconds
from loomspan.operators import chapters as C
from loomspan.operators.captions import second_lines
from loomspan.operators.latest import latest_row
from loomspan.operators.quality import current_comments
from loomspan.sources.tables import table


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "videos").filter(F.col("video_id").isNotNull()).select("video_id", "description", "duration_data", "last_updated")
    return latest_row(rows, ["video_id"], [F.col(c).desc_nulls_last() for c in ("last_updated", "description", "duration_data")])


def _chapters(spark: SparkSession, folder: str) -> DataFrame:
    rows = _videos(spark, folder).select("video_id", F.posexplode(C.chapter_marks(F.col("description"))).alias("i", "c"))
    return rows.select("video_id", "i", F.col("c.offset").alias("offset"), F.col("c.title").alias("title")).filter("title != ''")


def chapter_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters named in descriptions."""
    return _chapters(spark, folder)


def chapter_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions with seconds beside their times."""
    return _videos(spark, folder).filter("description IS NOT NULL").select("video_id", C.rewritten_marks(F.col("description")).alias("description"))


def chapter_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters with the start of the next."""
    one = latest_row(_chapters(spark, folder), ["video_id", "offset"], [F.col("i")])
    return C.intervals(one, "video_id").select("video_id", "offset", "chapter_no", "next_start")


def named_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """The chapter of each time named in a comment, with its place among the comment's times."""
    comments = current_comments(table(spark, folder, "comments"))
    times = comments.select("comment_id", "video_id", F.posexplode(timestamps(F.col("text"))).alias("place", "t")).select("comment_id", "video_id", "place", F.col("t.seconds").alias("second"))
    chapters = latest_row(_chapters(spark, folder), ["video_id", "offset"], [F.col("i")]).select("video_id", "offset")
    return C.chapter_at(times, chapters, "video_id", "second").select("comment_id", "place", "second", "chapter_no")


def timestamp_chapter_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The chapter of each time named in a comment."""
    return named_chapters(spark, folder).select("comment_id", "second", "chapter_no").distinct()


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """Headings as a model would write them: near the chapters, some seconds off, of changing level."""
    rows = _chapters(spark, folder).withColumn("h", F.pmod(F.length("title") * 31 + F.col("i") * 17, F.lit(83)))
    return rows.select("video_id", (F.col("offset") + F.col("h") - 20).cast("int").alias("offset"), (F.col("h") % 3 + 2).cast("int").alias("level"), F.upper("title").alias("title")).filter("offset >= 0")


def chapter_band_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters and headings within half a minute of each other."""
    return C.near_pairs(_chapters(spark, folder), _found(spark, folder), "video_id")


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """Headings and unmatched chapters of each video, as arrays."""
    pack = lambda df, *c: df.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*c))).alias("a"))
    manual, found = pack(_chapters(spark, folder), "offset", "title"), pack(_found(spark, folder), "offset", "level", "title")
    rows = _videos(spark, folder).select("video_id", duration_seconds(F.col("duration_data")).alias("duration"))
    both = rows.join(manual.withColumnRenamed("a", "manual"), "video_id").join(found.withColumnRenamed("a", "found"), "video_id", "left")
    return C.merged_headings(both, "video_id")


def _heading_text() -> Column:
    return F.transform("headings", lambda h: C.heading_line(h["offset"], h["level"], h["title"]))


def chapter_greedy_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with the titles of the chapters near them."""
    return _merged(spark, folder).select("video_id", F.array_join(_heading_text(), "\n").alias("headings"), F.size("unmatched").alias("unmatched"))


def reconciled_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Headings after a model has put in the chapters that found none near them."""
    merged = _merged(spark, folder)
    left = F.array_join(F.transform("unmatched", lambda c: F.concat_ws(" ", c["offset"].cast("string"), c["title"])), "\n")
    prompt = F.concat(F.lit("Table of contents.\n---\n"), F.array_join(_heading_text(), "\n"), F.lit("\n===\n"), left)
    answers = asked(merged.filter(F.size("unmatched") > 0).select("video_id", prompt.alias("prompt")), "video_id", "prompt", provider=profile_of("headings").provider)
    return answers.select("video_id", F.posexplode(C.headings(F.col("answer"))).alias("place", "h")).select("video_id", "place", "h.offset", "h.level", "h.title")


def chunk_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt for each chunk: what the chunk before ends with, then the chunk (its length stands for it here)."""
    chunks = _lines(spark, folder).filter("video_id IS NOT NULL")
    tail = F.array_join(C.last_paragraphs(F.col("transcript_chunk")), "\n")
    before = F.lag(tail).over(Window.partitionBy("video_id").orderBy("chunk_id"))
    prompt = F.format_string("Goes on after:\n%s\n---\n%s", F.coalesce(before, F.lit("(nothing)")), F.length("transcript_chunk"))
    return chunks.select("video_id", "chunk_id", prompt.alias("prompt"))


def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Headings written as lines and read again."""
    lines = _found(spark, folder).select("video_id", C.heading_line(F.col("offset"), F.col("level"), F.col("title")).alias("line"))
    return lines.select("video_id", F.explode(C.headings(F.col("line"))).alias("h")).select("video_id", "h.offset", "h.level", "h.title")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of every notation, as lines of seconds."""
    rows = table(spark, folder, "transcripts").filter(F.col("transcript_chunk").isNotNull()).select("video_id", "chunk_id", "transcript_chunk")
    one = latest_row(rows, ["video_id", "chunk_id"], [F.col("transcript_chunk").desc()])
    return one.select("video_id", "chunk_id", second_lines(F.col("transcript_chunk")).alias("transcript_chunk"))


def chunk_merge_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every notation without what the next one repeats."""
    return C.trimmed_chunks(_lines(spark, folder), "video_id", "chunk_id", "transcript_chunk")


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all documents in overlapping windows, counted."""
    lines = table(spark, folder, "documents").filter("text IS NOT NULL").select("source", "doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    return C.chunk_windows(lines, "pos").groupBy("doc_id", "chunk_no").agg(F.count(F.lit(1)).alias("words"))


def _interleaved(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    lines = C.trimmed_chunks(chunks, "video_id", "chunk_id", "transcript_chunk").select("video_id", "chunk_id", F.posexplode(F.split("transcript_chunk", "\n", -1)).alias("i", "line"))
    text = lines.withColumn("second", C.line_second(F.col("line"))).filter("second IS NOT NULL").withColumn("pos", F.col("chunk_id") * 100000 + F.col("i"))
    heads = _found(spark, folder).select("video_id", F.col("offset").alias("second"), F.col("offset").alias("pos"), C.heading_line(F.col("offset"), F.col("level"), F.col("title")).alias("line"))
    return C.interleaved(text, heads, "video_id")


def interleave_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of transcripts of every notation, and headings, in order of time."""
    return _interleaved(spark, folder, _lines(spark, folder))


def _tails(chunks: DataFrame) -> DataFrame:
    return chunks.select("video_id", "chunk_id", F.array_join(C.last_paragraphs(F.col("transcript_chunk")), "\n").alias("tail"))


def last_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The last two paragraphs of each chunk of every notation."""
    return _tails(_lines(spark, folder))


def best_transcript(spark: SparkSession, folder: str) -> DataFrame:
    """The language chosen for each video."""
    rows = table(spark, folder, "transcripts").select("video_id", "language_code", "is_generated").distinct()
    return C.best_transcript(rows, "video_id")


QUERIES = {f.__name__: f for f in (chapter_parse, chapter_rewrite, chapter_intervals, timestamp_chapter_asof, chapter_band_candidates, chapter_greedy_merge, reconciled_chapters, chunk_prompts, heading_lines, chunk_merge_trim, chunk_windows, interleave_headings, last_paragraphs, best_transcript)}

_S = SPACE
_MK = r"(?m)^[^\p{L}\p{N}_]*((?:\d{1,2}:)?\d{1,2}:\d{2})[^\p{L}\p{N}_]*(.*?)$"
_SEC = lambda e: f"list_reduce(list_transform(string_split({e}, ':'), lambda x: CAST(x AS INTEGER)), lambda a, b: a * 60 + b)"
_ONE = f"""v AS (SELECT video_id, description, duration_data FROM videos WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST, description DESC NULLS LAST, duration_data DESC NULLS LAST) = 1),
m AS (SELECT video_id, regexp_extract_all(description, '{_MK}', 1) AS ms, regexp_extract_all(description, '{_MK}', 2) AS ts FROM v),
u AS (SELECT video_id, generate_subscripts(ms, 1) - 1 AS i, unnest(ms) AS mark, unnest(ts) AS t FROM m),
c AS (SELECT video_id, i::INTEGER AS i, {_SEC("mark")} AS "offset", regexp_replace(t, '^[{_S}]+|[{_S}]+$', '', 'g') AS title FROM u WHERE regexp_matches(t, '[^{_S}]')),
c1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY video_id, "offset" ORDER BY i) = 1),
iv AS (SELECT video_id, "offset", (row_number() OVER w - 1)::INTEGER AS chapter_no, lead("offset") OVER w AS next_start FROM c1 WINDOW w AS (PARTITION BY video_id ORDER BY "offset"))"""
_FOUND = """fd0 AS (SELECT *, (length(title) * 31 + i * 17) % 83 AS h FROM c),
fd AS (SELECT video_id, ("offset" + h - 20)::INTEGER AS "offset", (h % 3 + 2)::INTEGER AS level, upper(title) AS title FROM fd0 WHERE "offset" + h - 20 >= 0)"""
_CL = r"(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?"
_FORMS = (rf"^\s*({_CL})\s*\|\s?(.*)$", rf"^\s*\[({_CL})\]\s?(.*)$", r"^\s*\((\d+(?:\.\d+)?)\s?s\)\s?(.*)$", r"^\s*(\d+(?:\.\d+)?):(?:\s(.*))?$", rf"^\s*({_CL})(?:\s(.*))?$", rf"^({_CL})\s*-->\s*{_CL}(.*)$")
_MARK = lambda n: "CASE form " + " ".join(f"WHEN {k} THEN regexp_extract(line, '{f}', {n})" for k, f in enumerate(_FORMS)) + " END"
# Chunks of any notation as lines 'second: text', as operators.captions has them.
_CHUNKS = rf"""k0 AS (SELECT video_id, chunk_id, max(transcript_chunk) AS t FROM transcripts WHERE transcript_chunk IS NOT NULL GROUP BY ALL),
k1 AS (SELECT video_id, chunk_id, generate_subscripts(string_split(t, chr(10)), 1) AS n, unnest(string_split(t, chr(10))) AS line FROM k0 WHERE t <> '' AND NOT regexp_matches(t, '^\d+: ')),
k2 AS (SELECT video_id, chunk_id, {", ".join(f"count(*) FILTER (regexp_matches(line, '{f}')) AS f{k}" for k, f in enumerate(_FORMS))} FROM k1 GROUP BY ALL),
k3 AS (SELECT video_id, chunk_id, CASE WHEN f5 > 0 THEN 5 {" ".join(f"WHEN f{k} = greatest(f0, f1, f2, f3, f4) THEN {k}" for k in range(5))} END AS form FROM k2),
k4 AS (SELECT k1.*, form, CASE form {" ".join(f"WHEN {k} THEN regexp_matches(line, '{f}')" for k, f in enumerate(_FORMS))} END AS hit FROM k1 JOIN k3 USING (video_id, chunk_id)),
k5 AS (SELECT *, CASE WHEN hit THEN round(1000 * list_reduce(list_transform(string_split(replace({_MARK(1)}, ',', '.'), ':'), lambda x: CAST(x AS DOUBLE)), lambda a, b: a * 60 + b)) END AS ms,
  lead(hit) OVER (PARTITION BY video_id, chunk_id ORDER BY n) AS next_hit FROM k4),
k6 AS (SELECT video_id, chunk_id, n, form = 4 AND abs(ms - p) > 60000 AND abs(ms - q) > 60000 AND abs(p - q) <= 60000 AS odd FROM (SELECT *, lag(ms) OVER w AS p, lead(ms) OVER w AS q FROM k5 WHERE hit WINDOW w AS (PARTITION BY video_id, chunk_id ORDER BY n))),
k7 AS (SELECT k5.*, hit AND NOT coalesce(odd, false) AS mark FROM k5 LEFT JOIN k6 USING (video_id, chunk_id, n)),
k8 AS (SELECT *, count(*) FILTER (mark) OVER (PARTITION BY video_id, chunk_id ORDER BY n) AS cap FROM k7),
k9 AS (SELECT video_id, chunk_id, cap, min(ms) FILTER (mark) AS ms, trim(regexp_replace(coalesce(string_agg(CASE WHEN mark AND form < 5 THEN {_MARK(2)} ELSE line END, ' ' ORDER BY n)
    FILTER (NOT (form = 5 AND (mark OR regexp_matches(trim(line), '^\d+$') AND coalesce(next_hit, false)))), ''), '[{_S}]+', ' ', 'g')) AS txt FROM k8 WHERE cap > 0 GROUP BY ALL),
k10 AS (SELECT video_id, chunk_id, string_agg(floor(ms / 1000)::BIGINT || ': ' || txt, chr(10) ORDER BY cap) AS t FROM k9 GROUP BY ALL),
k AS (SELECT video_id, chunk_id, coalesce(k10.t, k0.t) AS t FROM k0 LEFT JOIN k10 USING (video_id, chunk_id))"""
NAMED_SQL = rf"""WITH {_ONE}, cm AS (SELECT comment_id, video_id, text_original FROM comments WHERE comment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY last_seen DESC NULLS LAST) = 1),
x AS (SELECT comment_id, video_id, list_filter(regexp_extract_all(text_original, '\b(?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}\b'), lambda t: CAST(right(t, 2) AS INTEGER) < 60) AS xs FROM cm),
t AS (SELECT comment_id, video_id, generate_subscripts(xs, 1) - 1 AS place, unnest(xs) AS x FROM x),
s AS (SELECT comment_id, video_id, place, {_SEC("x")} AS second FROM t)
SELECT comment_id, place, second, chapter_no FROM s ASOF LEFT JOIN iv ON s.video_id = iv.video_id AND s.second >= iv."offset" """
ORACLE = {
    "chapter_rewrite": rf"""WITH {_ONE}, r AS (SELECT video_id, regexp_replace(description, '{_MK}', '[ts \1] \1 \2', 'g') AS t, list_distinct(regexp_extract_all(description, '{_MK}', 1)) AS ms FROM v WHERE description IS NOT NULL)
SELECT video_id, rtrim(list_reduce(list_prepend(t, ms), lambda a, m: replace(a, '[ts ' || m || ']', '[ts ' || ({_SEC("m")})::VARCHAR || ']')), ' ') AS description FROM r""",
    "chapter_parse": f"WITH {_ONE} SELECT * FROM c",
    "chapter_intervals": f"WITH {_ONE} SELECT * FROM iv",
    "timestamp_chapter_asof": rf"""WITH {_ONE}, cm AS (SELECT comment_id, video_id, text_original FROM comments WHERE comment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY last_seen DESC NULLS LAST) = 1),
t AS (SELECT DISTINCT comment_id, video_id, {_SEC("x")} AS second FROM (SELECT comment_id, video_id, unnest(list_filter(regexp_extract_all(text_original, '\b(?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}\b'), lambda t: CAST(right(t, 2) AS INTEGER) < 60)) AS x FROM cm))
SELECT comment_id, second, chapter_no FROM t ASOF LEFT JOIN iv ON t.video_id = iv.video_id AND t.second >= iv."offset" """,
    "chunk_prompts": rf"""WITH {_CHUNKS}, l AS (SELECT video_id, chunk_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\d+:\s')) AS ls FROM k)
SELECT video_id, chunk_id, 'Goes on after:' || chr(10) || coalesce(lag(array_to_string(ls[-2:], chr(10))) OVER (PARTITION BY video_id ORDER BY chunk_id), '(nothing)') || chr(10) || '---' || chr(10) || length(t) AS prompt FROM l WHERE video_id IS NOT NULL""",
    "last_paragraphs": rf"""WITH {_CHUNKS}, l AS (SELECT video_id, chunk_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\d+:\s')) AS ls FROM k) SELECT video_id, chunk_id, array_to_string(ls[-2:], chr(10)) AS tail FROM l""",
    "chunk_windows": """WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, max(pos) + 1 AS n FROM w GROUP BY 1), c AS (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 370.0) AS BIGINT))) AS chunk_no FROM n)
SELECT doc_id, chunk_no::INTEGER AS chunk_no, least(n - chunk_no * 370, 400)::BIGINT AS words FROM c""",
    "chunk_merge_trim": rf"""WITH {_CHUNKS}, l AS (SELECT video_id, chunk_id, generate_subscripts(string_split(trim(t, chr(10) || ' '), chr(10)), 1) AS n, unnest(string_split(trim(t, chr(10) || ' '), chr(10))) AS line FROM k),
s AS (SELECT *, CASE WHEN NOT starts_with(line, '##') AND contains(line, ':') THEN TRY_CAST(CASE WHEN regexp_matches(trim(string_split(line, ':')[1]), '^[+-]?\d{{1,9}}$') THEN trim(string_split(line, ':')[1]) END AS INTEGER) END AS sec FROM l),
f AS (SELECT video_id, chunk_id, arg_min(sec, n) FILTER (sec IS NOT NULL) AS first FROM s GROUP BY ALL), nx AS (SELECT video_id, chunk_id, lead(first) OVER (PARTITION BY video_id ORDER BY chunk_id) AS nxt FROM f),
ct AS (SELECT s.*, nxt, min(n) FILTER (sec >= nxt) OVER (PARTITION BY s.video_id, s.chunk_id) AS cut FROM s JOIN nx USING (video_id, chunk_id))
SELECT k.video_id, k.chunk_id, CASE WHEN any_value(nxt) IS NULL THEN any_value(t) ELSE coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (cut IS NULL OR n < cut), '') END AS transcript_chunk FROM ct JOIN k USING (video_id, chunk_id) GROUP BY k.video_id, k.chunk_id""",
    "chapter_band_candidates": f"""WITH {_ONE}, {_FOUND} SELECT c.video_id, c."offset" AS m_offset, c.title AS m_title, fd."offset" AS h_offset, fd.level FROM c JOIN fd ON c.video_id = fd.video_id AND abs(c."offset" - fd."offset") <= 30""",
    "heading_lines": f"""WITH {_ONE}, {_FOUND} SELECT video_id, "offset", level, regexp_replace(title, '[{_S}]+$', '') AS title FROM fd""",
    "interleave_headings": rf"""WITH {_ONE}, {_FOUND}, {_CHUNKS}, l AS (SELECT video_id, chunk_id, generate_subscripts(string_split(trim(t, chr(10) || ' '), chr(10)), 1) AS n, unnest(string_split(trim(t, chr(10) || ' '), chr(10))) AS line FROM k),
s AS (SELECT *, CASE WHEN NOT starts_with(line, '##') AND contains(line, ':') THEN TRY_CAST(CASE WHEN regexp_matches(trim(string_split(line, ':')[1]), '^[+-]?\d{{1,9}}$') THEN trim(string_split(line, ':')[1]) END AS INTEGER) END AS sec FROM l),
f AS (SELECT video_id, chunk_id, arg_min(sec, n) FILTER (sec IS NOT NULL) AS first FROM s GROUP BY ALL), nx AS (SELECT video_id, chunk_id, lead(first) OVER (PARTITION BY video_id ORDER BY chunk_id) AS nxt FROM f),
ct AS (SELECT s.*, min(n) FILTER (sec >= nxt) OVER (PARTITION BY s.video_id, s.chunk_id) AS cut FROM s JOIN nx USING (video_id, chunk_id))
SELECT video_id, sec AS second, 1 AS is_text, (chunk_id * 100000 + n - 1)::INTEGER AS pos, line FROM ct WHERE (cut IS NULL OR n < cut) AND sec IS NOT NULL
UNION ALL SELECT video_id, "offset", 0, "offset", concat("offset", ' ', repeat('#', level), ' ', title) FROM fd""",
    "best_transcript": """SELECT DISTINCT video_id, language_code, is_generated FROM transcripts QUALIFY dense_rank() OVER (PARTITION BY video_id ORDER BY CASE WHEN starts_with(language_code, 'en') AND NOT is_generated THEN 0 WHEN starts_with(language_code, 'en') THEN 1 ELSE 2 END, language_code NULLS LAST, is_generated) = 1""",
}
