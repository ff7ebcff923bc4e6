"""Queries over whole page trees, repeated inputs and texts, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, urls
from ..operators import tree
from ..storage import table

QUERIES: dict = {}
ORACLES: dict = {}
#: Queries that have no SQL; tests hold their operators against expected results.
TESTED: dict = {}


def query(sql: str | None = None):
    def add(f):
        if sql:
            QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        else:
            TESTED[f.__name__] = f
        return f

    return add


# What is in comments, scripts and styles has no elements of its own.
_BARE = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g')"


@query(rf"""with t as (select page_id, lower(unnest(regexp_extract_all({_BARE}, '<([A-Za-z][A-Za-z0-9-]*)', 1))) tag from pages)
select page_id, tag, count(*) n from t group by page_id, tag""")
def elements_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.elements(table(spark, sf_dir, "pages")).where("own").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(rf"""with a as (select page_id, regexp_extract_all({_BARE}, '(?is)<a\s[^>]*?href=("[^"]*"|''[^'']*'')', 1) h from pages),
o as (select page_id, unnest(h) h, cast(generate_subscripts(h, 1) - 1 as int) ordinal from a)
select page_id, ordinal, replace(trim(substr(h, 2, length(h) - 2)), '&amp;', '&') href from o""")
def anchors_any_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.anchors(table(spark, sf_dir, "pages")).select("page_id", "ordinal", "href")


@query(rf"""select page_id, cast(len(regexp_extract_all({_BARE}, '(?i)<div class="ad">')) as bigint) n from pages where regexp_matches({_BARE}, '(?i)<div class="ad">')""")
def css_advert_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.select_css(tree.elements(table(spark, sf_dir, "pages")), "div.ad").groupBy("page_id").agg(F.count("*").alias("n"))


@query(rf"""with p as (select page_id, cast(len(regexp_extract_all({_BARE}, '(?i)<p[\s>]')) as bigint) n from pages) select * from p where n > 0""")
def path_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.select_path(tree.elements(table(spark, sf_dir, "pages")), "//p").groupBy("page_id").agg(F.count("*").alias("n"))


@query()
def first_heading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_text(table(spark, sf_dir, "pages"), "h1")


@query()
def markdown_whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block kind of every page; tests compare each kind with what is expected."""
    return tree.markdown(table(spark, sf_dir, "pages"))


@query()
def remembered_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of first headings, remembered by host as JSON."""
    pages = table(spark, sf_dir, "pages")
    found = tree.fingerprints(tree.select(tree.elements(pages), "h1"), pages)
    hosts = pages.select(F.col("page_id").cast("long").alias("page_id"), urls.host(F.col("url")).alias("host"))
    return tree.remember(found.join(hosts, "page_id"), F.col("host"))


@query(r"""select doc_id, length(text) <= 100000 and octet_length(encode(text)) <= 262144 and not regexp_matches(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]') fine from documents""")
def generated_text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", checks.generated_text(F.col("text")).alias("fine"))


@query(r"""with q as (select conv_id, turn, trim(regexp_replace(text, '[\s\p{Z}\x{85}]+', ' ', 'g')) q from conversations)
select conv_id, turn, case when length(q) between 1 and 2048 then q end query from q""")
def queries_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", checks.normalized_query(F.col("text")).alias("query"))
