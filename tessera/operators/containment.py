"""Which of many names stand in which of many texts: an Aho-Corasick automaton for each block of names, run over slices of the texts.

Up to NAME_BYTES of names, which are counted first, go to every task, and the texts are read where they are. Beyond that names are dealt to
blocks of about NAME_BYTES and texts to slices of about TEXT_BYTES, both by hash; a block and a slice
meet in one task, which reads every text once for all names of its block. No pair of a text
and a name is looked at that does not hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.plans.query import registry
from tessera.sources.checkpoints import cut
from tessera.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

NAME_BYTES, TEXT_BYTES = 8 << 20, 64 << 20


def parts(df: DataFrame, column: str, most: int) -> int:
    return max(1, -(-(df.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0) // most))


class Finder:
    """The automaton of names (id, name)."""

    def __init__(self, known: pa.Table) -> None:
        import ahocorasick

        self.automaton, self.ids = ahocorasick.Automaton(), {}
        for i, name in zip(known.column("id").to_pylist(), known.column("name").to_pylist(), strict=True):
            self.ids.setdefault(name, []).append(i)
        for name in self.ids:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()

    def pairs(self, seen: pa.Table, whole_words: bool) -> tuple[list, list]:
        """Two columns, (query, id), of the texts of `seen` (query, text) and the names that stand in them."""
        found_query: list = []
        found_id: list = []
        if not self.ids:
            return found_query, found_id
        for q, text in zip(seen.column("query").to_pylist(), seen.column("text").to_pylist(), strict=True):
            first: dict[str, int] = {}
            for end, name in self.automaton.iter(text):
                first.setdefault(name, end + 1)
            edge = lambda name, end: text[max(end - len(name) - 1, 0) : end - len(name)].isalnum() or text[end : end + 1].isalnum()  # noqa: B023, E731
            hits = [name for name, end in first.items() if not whole_words or not edge(name, end)]
            for name in hits:
                found_id += self.ids[name]
                found_query += [q] * len(self.ids[name])
        return found_query, found_id


def contained(texts: DataFrame, names: DataFrame, whole_words: bool = False) -> DataFrame:
    """(query, id) of texts (query, text) and names (id, name) that they contain, once each.

    whole_words: only if no letter or digit stands in front of the name's first occurrence or behind it. Empty and null names are in no text;
    names that several ids share count for all of them.
    """
    query, id_ = (pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in (texts.schema["query"], names.schema["id"]))
    schema = f"query {'bigint' if query == pa.int64() else 'string'}, id {'bigint' if id_ == pa.int64() else 'string'}"
    left, right = names.filter("name != ''").select("id", "name"), texts.filter("text is not null").select("query", "text")
    table_ = lambda found: pa.table({"query": pa.array(found[0], query), "id": pa.array(found[1], id_)})
    size = left.agg(F.sum(F.octet_length("name") + F.octet_length(F.col("id").cast("string"))).alias("n")).first().n or 0
    if size <= NAME_BYTES:
        shared = names.sparkSession.sparkContext.broadcast(left.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                yield from table_(finder.pairs(pa.Table.from_batches([batch]), whole_words)).to_batches()

        return right.mapInArrow(scan, schema).distinct()
    blocks, slices = -(-size // NAME_BYTES), parts(right, "text", TEXT_BYTES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = left.select("id", "name", number("name", blocks).alias("block"), every(slices).alias("slice"))
    right = right.select("query", "text", number("query", slices).alias("slice"), every(blocks).alias("block"))
    search = lambda known, seen: table_(Finder(known).pairs(seen, whole_words))
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(search, schema).distinct()


#: Pages that a name is linked to.
PAGES_OF_NAME = 3


def related(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, page_id): the first PAGES_OF_NAME pages, by id, with an entity (page_id, entity) that contains the name or that the name contains, at word boundaries; all in lower case."""
    ours = cut(names.select(F.lower(F.trim("name")).alias("name")).filter("name != ''").distinct())
    theirs = cut(entities.select("page_id", F.lower(F.trim("entity")).alias("entity")).filter("entity != ''").distinct())
    each = cut(theirs.select("entity").distinct())
    text = lambda df, c: df.select(F.col(c).alias("query"), F.col(c).alias("text"))
    name = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("name"))
    inside = contained(text(each, "entity"), name(ours, "name"), True).select(F.col("id").alias("name"), F.col("query").alias("entity"))
    around = contained(text(ours, "name"), name(each, "entity"), True).select(F.col("query").alias("name"), F.col("id").alias("entity"))
    # A name's first pages are among the first pages of its entities.
    firsts = theirs.withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy("page_id"))).filter(F.col("k") <= PAGES_OF_NAME).drop("k")
    found = inside.unionByName(around).distinct().join(firsts, "entity").select("name", "page_id").distinct()
    return found.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("page_id"))).filter(F.col("k") <= PAGES_OF_NAME).drop("k")


LINK_TEXT, HEADING = r'<a href="[^"]*"[^>]*>([^<]+)<', r"<h[1-3][^>]*>([^<]+)<"


def _holds(hay: str, needle: str) -> str:
    at, edge = f"position({needle} IN {hay})", r"'[\p{L}\p{N}]'"
    return f"(contains({hay}, {needle}) AND NOT regexp_matches(substr({hay}, greatest({at} - 1, 1), CASE WHEN {at} > 1 THEN 1 ELSE 0 END), {edge}) AND NOT regexp_matches(substr({hay}, {at} + length({needle}), 1), {edge}))"


@query(f"""WITH e AS (SELECT DISTINCT page_id, lower(trim(x)) AS entity FROM (SELECT page_id, unnest(regexp_extract_all(html, '{LINK_TEXT}', 1)) AS x FROM pages) WHERE trim(x) <> ''),
n AS (SELECT DISTINCT lower(trim(x)) AS name FROM (SELECT unnest(list_concat(regexp_extract_all(html, '{LINK_TEXT}', 1), regexp_extract_all(html, '{HEADING}', 1))) AS x FROM pages WHERE page_id % 20 = 0) WHERE trim(x) <> ''),
m AS (SELECT DISTINCT name, page_id FROM n JOIN e ON {_holds("entity", "name")} OR {_holds("name", "entity")})
SELECT name, page_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS k FROM m) WHERE k <= {PAGES_OF_NAME}""")
def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link texts and headings of every page whose id is divisible by 20, with the pages whose link texts contain them or stand in them."""
    pages = table(spark, sf_dir, "pages")
    links = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    names = pages.filter("page_id % 20 = 0").select(F.explode(F.concat(links(LINK_TEXT), links(HEADING))).alias("name"))
    return related(names, pages.select("page_id", F.explode(links(LINK_TEXT)).alias("entity")))
