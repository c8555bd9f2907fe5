"""Queries of description blocks and boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import blocks as B
from loomspan.operators.latest import latest_row
from loomspan.operators.quality import current_channels
from loomspan.sources.tables import table

INDEXED_UNTIL = "2025-01-01 00:00:00"


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "videos").filter(F.col("video_id").isNotNull()).select("video_id", "channel_id", "description", "tags", "last_updated")
    return latest_row(rows, ["video_id"], [F.col("last_updated").desc_nulls_last(), F.col("channel_id").desc_nulls_last(), F.col("description").desc_nulls_last()])


def description_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block of every description."""
    return B.blocks(_videos(spark, folder))


def block_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that stand in three videos of a channel or more."""
    return B.frequencies(B.blocks(_videos(spark, folder))).filter(F.col("videos") >= B.REPEATED)


def block_channel_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks by channel."""
    return B.channel_stats(_videos(spark, folder))


def block_grand_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over all channels."""
    return B.grand_totals(_videos(spark, folder))


def boilerplate_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All channels, those with the largest share of repeated rows first."""
    rows = B.channel_stats(_videos(spark, folder)).withColumn("percent", F.round(100 * F.col("repeated_rows") / F.col("rows"), 4))
    return rows.select("channel_id", "percent").orderBy(F.col("percent").desc(), "channel_id")


def strip_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions without repeated link blocks."""
    return B.strip_boilerplate(_videos(spark, folder))


def unique_length(spark: SparkSession, folder: str) -> DataFrame:
    """The length of what is a description's own."""
    return B.unique_length(_videos(spark, folder))


def unindexed_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Videos whose present state an index built earlier doesn't have."""
    indexed = table(spark, folder, "videos").filter(F.col("last_updated") < F.lit(INDEXED_UNTIL).cast("timestamp_ntz")).select("video_id", "last_updated").distinct()
    return _videos(spark, folder).select("video_id", "last_updated").join(indexed, ["video_id", "last_updated"], "left_anti")


def clean_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags without the channel's own name."""
    titles = current_channels(table(spark, folder, "channels")).select("channel_id", "title")
    rows = _videos(spark, folder).join(titles, "channel_id").filter(X.strip(F.coalesce("title", F.lit(""))) != "")
    return rows.select("video_id", F.array_join(B.clean_tags(F.col("tags"), F.col("title")), "|").alias("tags"))


QUERIES = {f.__name__: f for f in (description_blocks, block_frequency, block_channel_stats, block_grand_totals, boilerplate_ranking, strip_boilerplate, unique_length, unindexed_videos, clean_tags)}

_S = X.SPACE
_ST = lambda e: f"regexp_replace({e}, '^[{_S}]+|[{_S}]+$', '', 'g')"
_DL = lambda e: rf"(length({e}) - coalesce(list_sum(list_transform(regexp_extract_all({e}, 'https?://\S+'), lambda u: greatest(0, length(u) - 20))), 0))"
_SEP = lambda e: f"NOT regexp_matches({e}, '[a-zA-Z0-9]')"
_HASH = lambda e: rf"regexp_matches({_ST(e)}, '^#\S+(?:\s+#\S+)*$')"
_BLOCKS = rf"""
v AS (SELECT video_id, channel_id, description, tags, last_updated FROM videos WHERE video_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST, channel_id DESC NULLS LAST, description DESC NULLS LAST) = 1),
l0 AS (SELECT video_id, string_split(regexp_replace(description, '\r\n?|[\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)) AS ls FROM v WHERE description IS NOT NULL),
l1 AS (SELECT video_id, CASE WHEN len(ls) >= 2 AND {_ST("ls[1]")} <> '' AND {_ST("ls[2]")} <> '' AND {_DL(_ST("ls[1]"))} < 120 AND {_DL(_ST("ls[2]"))} < 120
    THEN [ls[1], '', ls[2], ''] || ls[3:] ELSE ls END AS ls FROM l0),
l2 AS (SELECT video_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l1),
l3 AS (SELECT *, {_ST("line")} AS bare, {_ST("line")} <> '' AND {_SEP("line")} AS sep FROM l2),
l4 AS (SELECT *, sum(sep::INTEGER) OVER (PARTITION BY video_id ORDER BY n) AS seg FROM l3),
g AS (SELECT video_id, seg, count(*) FILTER (bare <> '' AND NOT sep) AS k, max(length(bare)) FILTER (bare <> '' AND NOT sep) AS longest FROM l4 GROUP BY ALL),
l5 AS (SELECT l4.*, coalesce(a.k, 0) = 1 AND a.longest <= 60 AND (b.k > 1 OR b.longest > 60) AS under FROM l4 JOIN g b USING (video_id, seg) LEFT JOIN g a ON a.video_id = l4.video_id AND a.seg = l4.seg - 1),
t AS (SELECT video_id, string_agg(CASE WHEN sep AND NOT coalesce(under, false) OR {_HASH("line")} THEN chr(10) || line || chr(10) ELSE line END, chr(10) ORDER BY n) AS whole FROM l5 GROUP BY 1),
r AS (SELECT video_id, list_filter(list_transform(regexp_split_to_array(whole, '\n\n+'), lambda b: {_ST("b")}), lambda b: b <> '') AS bs FROM t),
b AS (SELECT r.video_id, channel_id, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs) AS block FROM r JOIN v USING (video_id)),
bl AS (SELECT *, sha256(block) AS checksum FROM b),
fr AS (SELECT channel_id, checksum, count(DISTINCT video_id) AS videos FROM bl WHERE channel_id IS NOT NULL GROUP BY ALL),
bf AS (SELECT bl.*, coalesce(fr.videos >= 3, false) AS repeated FROM bl LEFT JOIN fr USING (channel_id, checksum)),
st AS (SELECT bl.channel_id, count(DISTINCT video_id) AS videos, count(DISTINCT (video_id, bl.checksum))::BIGINT AS rows, count(DISTINCT bl.checksum) AS checksums,
  count(DISTINCT (video_id, bl.checksum)) FILTER (fr.videos >= 3)::BIGINT AS repeated_rows FROM bl JOIN fr USING (channel_id, checksum) GROUP BY 1),
ul AS (SELECT v.video_id, v.channel_id, coalesce(length(regexp_replace(string_agg(block, chr(10) ORDER BY pos), '\n+', chr(10), 'g')), 0)::BIGINT AS unique_length
  FROM v LEFT JOIN (SELECT * FROM bf WHERE NOT repeated AND NOT ({_SEP("block")})) k USING (video_id) GROUP BY ALL)"""
ORACLE = {
    "description_blocks": f"WITH {_BLOCKS} SELECT video_id, channel_id, pos::INTEGER AS pos, block, checksum FROM bl",
    "block_frequency": f"WITH {_BLOCKS} SELECT channel_id, checksum, videos FROM fr WHERE videos >= 3",
    "block_channel_stats": f"WITH {_BLOCKS} SELECT * FROM st",
    "block_grand_totals": f"""WITH {_BLOCKS}, m AS (SELECT count(*)::BIGINT AS videos, avg(unique_length) AS mean FROM ul WHERE channel_id IS NOT NULL)
  SELECT videos, round(mean, 4) AS mean_unique_length, (SELECT round(100 * sum(repeated_rows) / sum(rows), 4) FROM st) AS boilerplate_percent FROM m""",
    "boilerplate_ranking": f"WITH {_BLOCKS} SELECT channel_id, round(100 * repeated_rows / rows, 4) AS percent FROM st ORDER BY percent DESC, channel_id",
    "strip_boilerplate": rf"""WITH {_BLOCKS}, k AS (SELECT * FROM bf WHERE NOT regexp_matches(block, 'https?://|@[\p{{L}}\p{{N}}_]') AND NOT {_HASH("block")} OR regexp_matches(block, '(?:^|\n)\d{{1,2}}:\d{{2}}') OR NOT repeated),
  o AS (SELECT * FROM k QUALIFY NOT ({_SEP("block")} AND coalesce({_SEP("lag(block) OVER (PARTITION BY video_id ORDER BY pos)")}, false))),
  e AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY video_id) AS c FROM o),
  j AS (SELECT video_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS s FROM e WHERE NOT ({_SEP("block")} AND (i = 1 OR i = c)) GROUP BY 1)
  SELECT video_id, CASE WHEN description IS NULL THEN NULL ELSE coalesce(s, '') END AS description FROM v LEFT JOIN j USING (video_id)""",
    "unique_length": f"WITH {_BLOCKS} SELECT * FROM ul",
    "unindexed_videos": f"WITH {_BLOCKS} SELECT video_id, last_updated FROM v WHERE NOT EXISTS (SELECT 1 FROM videos o WHERE o.video_id = v.video_id AND o.last_updated = v.last_updated AND o.last_updated < TIMESTAMP '{INDEXED_UNTIL}')",
    "clean_tags": f"""WITH {_BLOCKS}, ch AS (SELECT * FROM channels WHERE channel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY last_updated DESC NULLS LAST, received_at DESC NULLS LAST) = 1)
  SELECT video_id, array_to_string(list_filter(coalesce(v.tags, []), lambda x: NOT contains(lower(ch.title), lower(x)) AND NOT contains(lower(x), lower(ch.title))), '|') AS tags FROM v JOIN ch USING (channel_id) WHERE {_ST("coalesce(ch.title, '')")} <> ''""",
}
