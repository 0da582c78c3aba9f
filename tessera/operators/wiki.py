"""Pages as a wiki: links, degrees, orphans, citations and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.query import registry
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

HREF = r'<a href="/([^"/#?]+)"'


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target): distinct site links of each page."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("target")).select("page_id", F.lower("target").alias("target")).distinct()


LINKS_SQL = """links AS (SELECT DISTINCT page_id, lower(target) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/#?]+)"', 1)) AS target FROM pages))"""
#: A page is reached under the name that its host begins with.
SLUG_SQL = """slugs AS (SELECT page_id, lower(regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^./]+)', 1)) AS slug FROM pages)"""


def slugs(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.lower(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]+)", 1)).alias("slug"))


@query(f"WITH {LINKS_SQL} SELECT page_id, target FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "pages"))


@query(f"WITH {LINKS_SQL}, {SLUG_SQL} SELECT target, count(DISTINCT l.page_id) AS demanders FROM links l WHERE target NOT IN (SELECT slug FROM slugs) GROUP BY target")
def wanted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken targets and how many pages ask for them."""
    p = table(spark, sf_dir, "pages")
    known = slugs(p).select(F.col("slug").alias("target")).distinct()
    return links(p).join(known, "target", "left_anti").groupBy("target").agg(F.count("*").alias("demanders"))


@query(f"""WITH {LINKS_SQL}, {SLUG_SQL}, o AS (SELECT page_id, count(*) AS n_out FROM links GROUP BY page_id), i AS (SELECT target, count(*) AS n_in FROM links GROUP BY target)
SELECT page_id, slug, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, n_in IS NULL AS orphan FROM slugs LEFT JOIN o USING (page_id) LEFT JOIN i ON target = slug""")
def page_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    all_links = links(p)
    out = all_links.groupBy("page_id").agg(F.count("*").alias("n_out"))
    into = all_links.groupBy(F.col("target").alias("slug")).agg(F.count("*").alias("n_in"))
    joined = slugs(p).join(out, "page_id", "left").join(into, "slug", "left")
    return joined.select("page_id", "slug", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.col("n_in").isNull().alias("orphan"))


@query(f"""WITH {LINKS_SQL}, {SLUG_SQL}, k AS (SELECT DISTINCT slug FROM slugs) SELECT count(DISTINCT page_id) AS n_pages, count(*) AS n_links, count(*) FILTER (slug IS NULL) AS n_broken, count(DISTINCT target) AS n_targets FROM links LEFT JOIN k ON target = slug""")
def graph_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    known = slugs(p).select(F.col("slug").alias("target"), F.lit(1).alias("known")).distinct()
    return links(p).join(known, "target", "left").agg(F.count_distinct("page_id").alias("n_pages"), F.count("*").alias("n_links"), F.count_if(F.col("known").isNull()).alias("n_broken"), F.count_distinct("target").alias("n_targets"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(html) AS n_chars, len(regexp_extract_all(html, '<p[> ]')) AS n_paragraphs, md5(html) AS h FROM pages""")
def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.char_length("html").cast("long").alias("n_chars"), F.regexp_count("html", F.lit("<p[> ]")).cast("long").alias("n_paragraphs"), F.md5("html").alias("h"),
    )


@query("""WITH c AS (SELECT page_id, page_id % 1000 AS doc_id, md5(html) AS h FROM pages), j AS (SELECT page_id, c.doc_id, d.doc_id AS found, n_chars FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id)
SELECT page_id, CASE WHEN found IS NULL THEN 'chunk missing' WHEN n_chars > 2000 THEN 'source drift' ELSE 'fresh' END AS state FROM j""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each page's cited document: missing, drifted (longer than what was recorded) or fresh."""
    c = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 1000).alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(1).alias("found"))
    return c.join(d, "doc_id", "left").select("page_id", F.when(F.col("found").isNull(), "chunk missing").when(F.col("n_chars") > 2000, "source drift").otherwise("fresh").alias("state"))


def citations(pages: DataFrame, text: str = "text") -> DataFrame:
    """(page_id, section, doc, chunk) of `<!-- cite:doc#id -->` anchors, by `## ` section."""
    sections = pages.select("page_id", F.posexplode(F.split(text, r"(?m)^## ")).alias("section", "body"))
    anchors = sections.select("page_id", "section", F.explode(F.regexp_extract_all("body", F.lit(r"<!-- cite:([^#\s]+#\d+) -->"), F.lit(1))).alias("a"))
    return anchors.select("page_id", "section", F.substring_index("a", "#", 1).alias("doc"), F.substring_index("a", "#", -1).cast("long").alias("chunk"))
