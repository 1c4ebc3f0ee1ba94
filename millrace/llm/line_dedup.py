"""Site-relative line frequency: lines on too large a share of a site's pages are boilerplate.

A page counts each of its lines once. A line goes from every page of a site if it is on at
least `min_count` of the site's pages and on more than `max_ratio` of them. DataFrame
functions only.

Scale: pages per line are counted by map-side partial sums of 128-bit line keys, so one hot
site or line costs each task one row. A site can have at most (mean lines a page / max_ratio)
such lines, so the boilerplate list of a site is short whatever the site's size. The lists are
broadcast up to `max_broadcast_lines` of them; beyond that the lines meet them in a shuffled
join keyed by site and line, and only the page ids with matches meet the text.

Defined results: a null text is empty, with one blank line; blank lines are never dropped or
counted; a null site is a site of its own; repeated rows are pages of their own; an empty
table gives an empty result; other columns pass through, whatever their names, but in
`drop_boilerplate` n_lines and n_dropped give way to the counts, which `without_boilerplate` does not add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, plain, table, written

MAX_RATIO, MIN_COUNT, MAX_BROADCAST_LINES = 0.1, 5, 50_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128 bits of the trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def _page_keys(text: str) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_count: int = MIN_COUNT) -> DataFrame:
    """The lines to drop: _site, _key, pages with the line, pages of the site."""
    pages = docs.select(F.col(site).alias("_site"), _page_keys(text).alias("_keys"))
    # one pass: each page also counts under a key that no line has
    marker = F.struct(F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    counted = pages.select("_site", F.explode(F.concat(F.array(marker), "_keys")).alias("_key")).groupBy("_site", "_key").agg(F.count("*").alias("n_pages"))
    frequent = written(counted.where((F.col("n_pages") >= min_count) | F.col("_key.b").isNull()), "line-counts")
    totals = frequent.where(F.col("_key.b").isNull()).select(F.col("_site").alias("_s"), F.col("n_pages").alias("site_pages"))
    found = frequent.where(F.col("_key.b").isNotNull()).join(totals, F.col("_site").eqNullSafe(F.col("_s"))).drop("_s")
    return found.where(F.col("n_pages") > max_ratio * F.col("site_pages"))


def _marked(docs: DataFrame, site: str, text: str, max_ratio: float, min_count: int, max_broadcast_lines: int) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: the line keys to drop, or null."""
    name, row, own_site = fresh(docs, "drop_keys", "row_number", "own_site")
    drop = written(boilerplate(docs, site, text, max_ratio, min_count), "boilerplate")
    if drop.count() <= max_broadcast_lines:
        lists = drop.groupBy(F.col("_site").alias(own_site)).agg(F.collect_list("_key").alias(name))
        return docs.join(F.broadcast(lists), F.col(site).eqNullSafe(F.col(own_site)), "left").select(*docs.columns, name), name
    # row numbers are written down: another scan might split its input otherwise
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    pairs = keyed.select(F.col(row).alias("_row"), F.col(site).alias("_site"), F.explode(_page_keys(text)).alias("_key"))
    hits = pairs.alias("p").join(drop.alias("d"), F.col("p._site").eqNullSafe(F.col("d._site")) & (F.col("p._key") == F.col("d._key")), "left_semi")
    return keyed.join(hits.groupBy(F.col("_row").alias(row)).agg(F.collect_list("_key").alias(name)), row, "left").select(*docs.columns, name), name


def _left(text: str, name: str) -> Column:
    lines = _lines(text)
    return F.when(F.col(name).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(name), _key(x))))


def drop_boilerplate(
    docs: DataFrame,
    site: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_count: int = MIN_COUNT,
    max_broadcast_lines: int = MAX_BROADCAST_LINES,
) -> DataFrame:
    """docs with `text` rid of its site's boilerplate, and n_lines, n_dropped."""
    docs, back = plain(docs, site=site, text=text)
    marked, name = _marked(docs, "site", "text", max_ratio, min_count, max_broadcast_lines)
    cut = marked.withColumn("left_lines", _left("text", name))
    n_lines = F.size(_lines("text")).cast("long")
    kept = [F.array_join("left_lines", "\n").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return back(cut.select(*kept, n_lines.alias("n_lines"), (n_lines - F.size("left_lines")).alias("n_dropped")), "n_lines", "n_dropped")


def without_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_count: int = MIN_COUNT, max_broadcast_lines: int = MAX_BROADCAST_LINES) -> DataFrame:
    """docs with `text` rid of its site's boilerplate."""
    docs, back = plain(docs, site=site, text=text)
    marked, name = _marked(docs, "site", "text", max_ratio, min_count, max_broadcast_lines)
    return back(marked.withColumn("text", F.array_join(_left("text", name), "\n")))


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH doc AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM doc),
pages AS (SELECT source, count(*) AS site_pages FROM documents GROUP BY source),
seen AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n_pages FROM line WHERE trim(line, ' ') <> '' GROUP BY ALL),
bad AS (SELECT seen.source, line FROM seen JOIN pages USING (source) WHERE n_pages >= 5 AND n_pages > 0.1 * site_pages),
marked AS (SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AS bad FROM line l LEFT JOIN bad b ON l.source = b.source AND trim(l.line, ' ') = b.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE bad))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
