"""Markdown pages of a wiki: frontmatter, links outside of code, sections, citations, and what verification finds wrong.

The given pages are HTML, so `notes` writes one Markdown page for each of them: frontmatter, links, a code block, three
sections with and without citations, and a list of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.query import registry
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

NOTES = """SELECT page_id, concat('page-', page_id) AS slug, concat('---', chr(10), 'title: Page ', page_id, chr(10), 'sources: [d', page_id % 7, ', d', page_id % 11, ']', chr(10), 'edited: ', CASE WHEN page_id % 4 = 0 THEN 'true' ELSE 'false' END, chr(10), '---', chr(10),
  '# Page ', page_id, chr(10), chr(10), 'See [[Page ', page_id * 7 % 300, '|that one]], [[page-', page_id * 3 % 400, '.md]] and [[Page ', page_id * 7 % 300, ']].', chr(10), chr(10), '```', chr(10), '[[no link]]', chr(10), '```', chr(10), chr(10),
  '## One', chr(10), 'A claim. <!-- cite:d', page_id % 7, '#', page_id % 13, ' -->', chr(10), chr(10), '## Two', chr(10), CASE WHEN page_id % 3 = 0 THEN 'No anchor.' ELSE concat('More. <!-- cite:d', page_id % 5, '#', page_id % 17, ' --> <!-- cite:d9#', page_id % 3, ' -->') END, chr(10), chr(10),
  '## Sources', chr(10), '- d', page_id % 7, chr(10), '- d', page_id % 11, CASE WHEN page_id % 6 = 0 THEN concat(chr(10), '- d8') ELSE '' END, chr(10)) AS body FROM {pages}"""
#: The chunks that pages may cite, out of the documents.
CITED = "SELECT concat('d', doc_id % 11) AS doc, doc_id % 19 AS chunk FROM {documents} WHERE doc_id < 3 * 11 * 19 AND doc_id % 5 <> 0 GROUP BY 1, 2"
NOTES_SQL = f"notes AS ({NOTES.format(pages='pages')})"
CITED_SQL = f"cited AS ({CITED.format(documents='documents')})"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NOTES, pages=table(spark, sf_dir, "pages"))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CITED, documents=table(spark, sf_dir, "documents"))


def normal(target: Column) -> Column:
    """A link's target as a slug: no display text, no .md, lower case, blanks to hyphens."""
    return F.replace(F.lower(F.regexp_replace(F.trim(F.substring_index(target, "|", 1)), r"\.md$", "")), F.lit(" "), F.lit("-"))


def links(pages: DataFrame) -> DataFrame:
    """(slug, target, place) of all [[links]] of (slug, body) outside of code fences, in order."""
    plain = F.regexp_replace("body", r"(?ms)^```.*?^```[ \t]*$", "")
    return pages.select("slug", F.posexplode(F.regexp_extract_all(plain, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("place", "raw")).select("slug", normal(F.col("raw")).alias("target"), F.col("place").cast("long").alias("place")).filter("target != ''")


LINKS_SQL = r"""raw AS (SELECT slug, regexp_extract_all(regexp_replace(body, '(?ms)^```.*?^```[ \t]*$', '', 'g'), '\[\[([^\[\]]+)\]\]', 1) AS l FROM notes),
links AS (SELECT slug, replace(lower(regexp_replace(trim(string_split(x, '|')[1]), '\.md$', '')), ' ', '-') AS target, k - 1 AS place FROM (SELECT slug, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM raw))"""


@query(f"WITH {NOTES_SQL}, {LINKS_SQL} SELECT slug, target, place FROM links")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(notes(spark, sf_dir))


def link_graph(pages: DataFrame) -> DataFrame:
    """(slug, n_out, n_in, n_broken, self_link, orphan) of every page: distinct links, those to no page, and pages that none other links to."""
    edge = links(pages).select("slug", "target").distinct()
    known = pages.select(F.col("slug").alias("target"), F.lit(1).alias("known"))
    e = edge.join(known, "target", "left")
    out = e.groupBy("slug").agg(F.count("*").alias("n_out"), F.count_if(F.col("known").isNull()).alias("n_broken"), F.max(F.col("slug") == F.col("target")).alias("self_link"))
    into = e.filter("known = 1 and slug != target").groupBy(F.col("target").alias("slug")).agg(F.count("*").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select("slug").join(out, "slug", "left").join(into, "slug", "left").select("slug", zero("n_out"), zero("n_in"), zero("n_broken"), F.coalesce("self_link", F.lit(False)).alias("self_link"), F.col("n_in").isNull().alias("orphan"))


GRAPH_SQL = """edge AS (SELECT DISTINCT slug, target FROM links), e AS (SELECT edge.*, n.slug AS known FROM edge LEFT JOIN notes n ON n.slug = target),
o AS (SELECT slug, count(*) AS n_out, count(*) FILTER (known IS NULL) AS n_broken, bool_or(slug = target) AS self_link FROM e GROUP BY slug), i AS (SELECT target AS slug, count(*) AS n_in FROM e WHERE known IS NOT NULL AND slug <> target GROUP BY target),
graph AS (SELECT slug, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_broken, 0) AS n_broken, coalesce(self_link, false) AS self_link, n_in IS NULL AS orphan FROM notes LEFT JOIN o USING (slug) LEFT JOIN i USING (slug))"""


@query(f"WITH {NOTES_SQL}, {LINKS_SQL}, {GRAPH_SQL} SELECT * FROM graph")
def note_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph(notes(spark, sf_dir))


@query(f"WITH {NOTES_SQL}, {LINKS_SQL} SELECT target, count(DISTINCT slug) AS n_demanders, string_agg(DISTINCT slug, ',' ORDER BY slug) AS demanders FROM links WHERE target NOT IN (SELECT slug FROM notes) GROUP BY target")
def wanted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are linked to and missing, with those that ask for them."""
    pages = notes(spark, sf_dir)
    broken = links(pages).select("slug", "target").distinct().join(pages.select(F.col("slug").alias("target")), "target", "left_anti")
    return broken.groupBy("target").agg(F.count("*").alias("n_demanders"), F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("demanders"))


@query(f"""WITH RECURSIVE {NOTES_SQL}, {LINKS_SQL}, edge AS (SELECT DISTINCT slug, target FROM links WHERE target IN (SELECT slug FROM notes)), reach(slug) AS (SELECT 'page-1' UNION SELECT target FROM reach JOIN edge USING (slug)) SELECT slug FROM notes WHERE slug NOT IN (SELECT slug FROM reach)""")
def unreachable_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no path of links from the start page leads to: the frontier grows until it is empty."""
    from tessera.sources.checkpoints import cut

    pages = notes(spark, sf_dir)
    edge = cut(links(pages).select("slug", "target").distinct().join(pages.select(F.col("slug").alias("target")), "target", "left_semi"))
    seen = frontier = pages.select("slug").filter("slug = 'page-1'")
    while not frontier.isEmpty():
        step = edge.join(frontier, "slug").select(F.col("target").alias("slug")).distinct()
        frontier = cut(step.join(seen, "slug", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return pages.select("slug").join(seen, "slug", "left_anti")


def sections(pages: DataFrame) -> DataFrame:
    """(slug, place, title, text) of the `## ` sections."""
    parts = pages.select("slug", F.posexplode(F.split("body", r"(?m)^## ")).alias("place", "part")).filter("place > 0")
    return parts.select("slug", F.col("place").cast("long").alias("place"), F.trim(F.substring_index("part", "\n", 1)).alias("title"), F.expr("substring(part, char_length(substring_index(part, '\n', 1)) + 2)").alias("text"))


def citations(pages: DataFrame) -> DataFrame:
    """(slug, place, doc, chunk): the `<!-- cite:doc#id -->` anchors of each section."""
    found = sections(pages).select("slug", "place", F.explode(F.regexp_extract_all("text", F.lit(r"<!-- cite:([^#\s]+#\d+) -->"), F.lit(1))).alias("a"))
    return found.select("slug", "place", F.substring_index("a", "#", 1).alias("doc"), F.substring_index("a", "#", -1).cast("long").alias("chunk"))


def listed_sources(pages: DataFrame) -> DataFrame:
    """(slug, doc) of the list in the section called Sources."""
    return sections(pages).filter("title = 'Sources'").select("slug", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^- (\S+)$"), F.lit(1))).alias("doc")).distinct()


SECTIONS_SQL = r"""parts AS (SELECT slug, string_split(regexp_replace(body, '(?m)^## ', chr(1), 'g'), chr(1)) AS l FROM notes), part AS (SELECT slug, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS place FROM parts),
sec AS (SELECT slug, place, trim(string_split(part, chr(10))[1]) AS title, substr(part, length(string_split(part, chr(10))[1]) + 2) AS text FROM part WHERE place > 0),
cites AS (SELECT slug, place, string_split(a, '#')[1] AS doc, string_split(a, '#')[2]::BIGINT AS chunk FROM (SELECT slug, place, unnest(regexp_extract_all(text, '<!-- cite:([^#\s]+#\d+) -->', 1)) AS a FROM sec)),
src AS (SELECT DISTINCT slug, doc FROM (SELECT slug, unnest(regexp_extract_all(text, '(?m)^- (\S+)$', 1)) AS doc FROM sec WHERE title = 'Sources'))"""


@query(f"WITH {NOTES_SQL}, {SECTIONS_SQL} SELECT sec.slug, sec.place, title, count(doc) AS n_citations FROM sec LEFT JOIN cites ON sec.slug = cites.slug AND sec.place = cites.place GROUP BY sec.slug, sec.place, title")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = notes(spark, sf_dir)
    return sections(pages).join(citations(pages).groupBy("slug", "place").agg(F.count("*").alias("n")), ["slug", "place"], "left").select("slug", "place", "title", F.coalesce("n", F.lit(0)).alias("n_citations"))


def problems(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(slug, kind, what): a cited document or chunk that is not there, a citation of an unlisted source, a listed source that nothing cites, a content section without citation, a broken link, a page without sources."""
    c, listed = citations(pages), listed_sources(pages)
    docs = chunks.select("doc").distinct()
    content = sections(pages).filter("title != 'Sources'")
    known = pages.select(F.col("slug").alias("target"))
    kinds = {
        "document missing": c.join(docs, "doc", "left_anti").select("slug", F.col("doc").alias("what")),
        "chunk missing": c.join(docs, "doc", "left_semi").join(chunks, ["doc", "chunk"], "left_anti").select("slug", F.concat("doc", F.lit("#"), "chunk").alias("what")),
        "source not listed": c.join(listed, ["slug", "doc"], "left_anti").select("slug", F.col("doc").alias("what")),
        "source not cited": listed.join(c, ["slug", "doc"], "left_anti").select("slug", F.col("doc").alias("what")),
        "section without citation": content.join(c, ["slug", "place"], "left_anti").select("slug", F.col("title").alias("what")),
        "broken link": links(pages).join(known, "target", "left_anti").select("slug", F.col("target").alias("what")),
        "no sources": pages.select("slug").join(listed, "slug", "left_anti").select("slug", F.lit("").alias("what")),
    }
    found = None
    for kind, rows in kinds.items():
        part = rows.distinct().select("slug", F.lit(kind).alias("kind"), "what")
        found = part if found is None else found.unionByName(part)
    return found


PROBLEMS_SQL = """problems AS (SELECT DISTINCT slug, 'document missing' AS kind, doc AS what FROM cites WHERE doc NOT IN (SELECT doc FROM cited)
UNION SELECT slug, 'chunk missing', doc || '#' || chunk FROM cites WHERE doc IN (SELECT doc FROM cited) AND NOT EXISTS (SELECT 1 FROM cited WHERE cited.doc = cites.doc AND cited.chunk = cites.chunk)
UNION SELECT slug, 'source not listed', doc FROM cites WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.slug = cites.slug AND src.doc = cites.doc)
UNION SELECT slug, 'source not cited', doc FROM src WHERE NOT EXISTS (SELECT 1 FROM cites WHERE src.slug = cites.slug AND src.doc = cites.doc)
UNION SELECT slug, 'section without citation', title FROM sec WHERE title <> 'Sources' AND NOT EXISTS (SELECT 1 FROM cites WHERE sec.slug = cites.slug AND sec.place = cites.place)
UNION SELECT slug, 'broken link', target FROM links WHERE target NOT IN (SELECT slug FROM notes)
UNION SELECT slug, 'no sources', '' FROM notes WHERE slug NOT IN (SELECT slug FROM src))"""


@query(f"WITH {NOTES_SQL}, {CITED_SQL}, {LINKS_SQL}, {SECTIONS_SQL}, {PROBLEMS_SQL} SELECT * FROM problems")
def note_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems(notes(spark, sf_dir), cited(spark, sf_dir))


@query(f"""WITH {NOTES_SQL}, {SECTIONS_SQL}, c AS (SELECT slug, place, count(*) AS n FROM cites GROUP BY slug, place) SELECT sec.slug, count(*) AS n_sections, count(n) AS n_cited, round(count(n) / count(*), 4) AS coverage FROM sec LEFT JOIN c ON sec.slug = c.slug AND sec.place = c.place WHERE title <> 'Sources' GROUP BY sec.slug""")
def note_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited content sections by all content sections."""
    pages = notes(spark, sf_dir)
    c = citations(pages).select("slug", "place", F.lit(1).alias("one")).distinct()
    s = sections(pages).filter("title != 'Sources'").join(c, ["slug", "place"], "left")
    return s.groupBy("slug").agg(F.count("*").alias("n_sections"), F.count("one").alias("n_cited"), F.round(F.count("one") / F.count("*"), 4).alias("coverage"))


def frontmatter(pages: DataFrame) -> DataFrame:
    """(slug, title, sources, edited, content): the fields between the first two lines of three hyphens, and the rest; without a title the slug."""
    head = F.regexp_extract("body", r"(?s)\A---\n(.*?\n)---\n", 1)
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?m)^{name}: *(.*)$", 1))
    items = F.filter(F.transform(F.split(F.regexp_replace(field("sources"), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select("slug", F.when(field("title") == "", F.col("slug")).otherwise(field("title")).alias("title"), items.alias("sources"), (field("edited") == "true").alias("edited"), F.regexp_replace("body", r"(?s)\A---\n.*?\n---\n", "").alias("content"))


def serialised(meta: DataFrame) -> DataFrame:
    """(slug, body) back from frontmatter()."""
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nsources: ["), F.array_join("sources", ", "), F.lit("]\nedited: "), F.when(F.col("edited"), "true").otherwise("false"), F.lit("\n---\n"))
    return meta.select("slug", F.concat(head, "content").alias("body"))


@query(f"""WITH {NOTES_SQL}, m AS (SELECT slug, regexp_extract(body, 'title: (.*)', 1) AS title, regexp_extract(body, 'sources: \\[([^\\]]*)\\]', 1) AS s, contains(body, 'edited: true') AS edited, md5(body) AS h FROM notes) SELECT slug, title, len(string_split(s, ', '))::BIGINT AS n_sources, edited, h FROM m""")
def note_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every page, and the digest of the page written again from them."""
    m = frontmatter(notes(spark, sf_dir))
    return m.join(serialised(m), "slug").select("slug", "title", F.size("sources").cast("long").alias("n_sources"), "edited", F.md5("body").alias("h"))


@query(f"""WITH {NOTES_SQL}, {SECTIONS_SQL}, a AS (SELECT DISTINCT slug, place, chunk, doc || '#' || chunk AS anchor FROM cites), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY place, chunk, anchor) AS k FROM a),
l AS (SELECT slug, string_agg(anchor, ' ' ORDER BY k) FILTER (k <= 3) AS anchors, count(DISTINCT place) AS n_anchored FROM r GROUP BY slug) SELECT slug, 'Page ' || page_id AS title, page_id % 4 = 0 AS edited, coalesce(anchors, '') AS anchors, coalesce(n_anchored, 0) AS n_anchored FROM notes LEFT JOIN l USING (slug)""")
def note_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of each page: title, whether edited, its first three anchors by section and chunk, and how many sections have any."""
    pages = notes(spark, sf_dir)
    a = citations(pages).select("slug", F.struct("place", "chunk", F.concat("doc", F.lit("#"), "chunk").alias("anchor")).alias("a"))
    one = a.groupBy("slug").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_set("a")), 1, 3), lambda x: x["anchor"]), " ").alias("anchors"), F.count_distinct("a.place").alias("n_anchored"))
    return frontmatter(pages).join(one, "slug", "left").select("slug", "title", "edited", F.coalesce("anchors", F.lit("")).alias("anchors"), F.coalesce("n_anchored", F.lit(0)).alias("n_anchored"))


@query(f"""WITH {NOTES_SQL}, {SECTIONS_SQL}, rec AS (SELECT slug, doc, chunk FROM cites WHERE chunk % 2 = 0) SELECT slug, doc, chunk FROM (SELECT DISTINCT slug, doc, chunk FROM cites) c WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.slug = c.slug AND rec.doc = c.doc AND rec.chunk = c.chunk)""")
def anchor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in the text that the recorded citations (here: the even ones) lack."""
    c = citations(notes(spark, sf_dir)).select("slug", "doc", "chunk").distinct()
    return c.join(c.filter("chunk % 2 = 0"), ["slug", "doc", "chunk"], "left_anti")


@query(f"""WITH {NOTES_SQL}, {SECTIONS_SQL}, live AS (SELECT 'd' || (doc_id % 11) AS doc, max(md5(text)) AS h FROM documents GROUP BY 1), rec AS (SELECT slug, doc, CASE WHEN length(slug) % 2 = 0 THEN h ELSE md5(slug) END AS h FROM src LEFT JOIN live USING (doc)),
w AS (SELECT slug, 'source missing' AS why FROM rec WHERE doc NOT IN (SELECT doc FROM live) UNION SELECT rec.slug, 'source drift' FROM rec JOIN live USING (doc) WHERE rec.h <> live.h UNION SELECT slug, 'hand edited' FROM notes WHERE page_id % 4 = 0)
SELECT slug, coalesce(string_agg(why, ',' ORDER BY why), '') AS reasons FROM notes LEFT JOIN w USING (slug) GROUP BY slug""")
def note_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each page is stale, if it is: a listed source is gone or has another hash than what was recorded, or somebody edited the page."""
    pages = notes(spark, sf_dir)
    live = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("d"), F.col("doc_id") % 11).alias("doc")).agg(F.max(F.md5("text")).alias("live"))
    rec = listed_sources(pages).join(live, "doc", "left").withColumn("recorded", F.when(F.char_length("slug") % 2 == 0, F.col("live")).otherwise(F.md5("slug")))
    why = rec.select("slug", F.when(F.col("live").isNull(), "source missing").when(F.col("recorded") != F.col("live"), "source drift").alias("why"))
    why = why.unionByName(frontmatter(pages).filter("edited").select("slug", F.lit("hand edited").alias("why"))).filter("why is not null")
    reasons = why.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))
    return pages.select("slug").join(reasons, "slug", "left").select("slug", F.coalesce("reasons", F.lit("")).alias("reasons"))


@query(f"""WITH {NOTES_SQL}, {LINKS_SQL}, {GRAPH_SQL} SELECT count(*) AS n_pages, sum(n_out)::BIGINT AS n_edges, sum(n_broken)::BIGINT AS n_broken, count(*) FILTER (orphan) AS n_orphans, count(*) FILTER (self_link) AS n_self FROM graph""")
def note_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the whole link graph."""
    return link_graph(notes(spark, sf_dir)).agg(F.count("*").alias("n_pages"), F.sum("n_out").alias("n_edges"), F.sum("n_broken").alias("n_broken"), F.count_if("orphan").alias("n_orphans"), F.count_if("self_link").alias("n_self"))
