"""Texts and pages: slugs, tags, keyword rules, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import html
from ..sources.files import table


def part_slugs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    name = F.concat(F.col("p_name"), F.lit(" & Co. "), F.col("p_brand"))
    return p.select("p_partkey", t.slug(name).alias("slug"), t.slug(name, "en").alias("slug_en"), t.truncate("p_name", 8).alias("short"), t.type_tags(F.when(F.col("p_size") > 25, "City Bike").otherwise("forrest bike"))[0].alias("tag"))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The length and hash of each page's text without tags."""
    own = t.strip_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(own).cast("long").alias("n_chars"), F.md5(own.cast("binary")).alias("hash"))


def page_escapes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(t.linked("url").cast("binary")).alias("linked"), F.md5(t.escape_html("html").cast("binary")).alias("escaped"))


def poi_types(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of points whose titles are made from parts and words for buildings."""
    p = table(spark, sf, "part")
    word = F.element_at(F.array(*map(F.lit, ("Oude Molen", "Gentbrugse weg", "brug 12", "Wandelnetwerk Noord", "bos"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", t.poi_type(F.when(F.col("p_partkey") % 11 == 0, "Locaties"), word, F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("kind"))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocks of each type a page has."""
    return html.block_counts(table(spark, sf, "pages"), "page_id", "html")


def page_parts(spark: SparkSession, sf: str) -> DataFrame:
    own = html.place_page()(F.col("html"))
    parts = table(spark, sf, "pages").select("page_id", own.alias("p"))
    return parts.select("page_id", F.size("p.faqs").alias("n_faqs"), F.size("p.cards").alias("n_cards"), F.size("p.videos").alias("n_videos"), F.size("p.sections").alias("n_sections"))


def document_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text, language or source hold the words."""
    from ..operators.rows import search

    return search(table(spark, sf, "documents"), ["text", "lang", "source"], " The ").select("doc_id")


QUERIES = {"part_slugs": part_slugs, "page_texts": page_texts, "page_escapes": page_escapes, "poi_types": poi_types, "page_blocks": page_blocks, "page_parts": page_parts, "document_search": document_search}

ORACLE_SQL = {
    "part_slugs": r"""
WITH n AS (SELECT *, lower(p_name || ' & Co. ' || p_brand) AS x FROM part)
SELECT p_partkey, trim(regexp_replace(x, '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(replace(x, '&', ' en '), '[^a-z0-9]+', '-', 'g'), '-') AS slug_en,
  CASE WHEN length(p_name) > 8 THEN rtrim(left(p_name, 7)) || '…' ELSE p_name END AS short, CASE WHEN p_size > 25 THEN 'Stadsfietsroute' ELSE 'Bosfietsroute' END AS tag FROM n""",
    "page_texts": r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, replace(regexp_replace(x, '(?i)&amp;', '&', 'g'), '&#39;', '''') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '&#039;', ''''), '(?i)&quot;', '"', 'g'), '(?i)&apos;', '''', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g') AS x FROM b),
d AS (SELECT page_id, trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS x FROM c)
SELECT page_id, length(x)::BIGINT AS n_chars, md5(x) AS hash FROM d""",
    "page_escapes": r"""
WITH p AS (SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS h, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS u FROM pages)
SELECT page_id, md5(replace(regexp_replace(u, '(https?://[^\s<]+)', '<a href="\1">\1</a>', 'g'), chr(10), '<br>')) AS linked, md5(h) AS escaped FROM p""",
    "poi_types": """
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Locaties' ELSE ['Gebouwen', 'Locaties', 'Gebouwen', 'Wandelnetwerken', 'Locaties'][p_partkey % 5 + 1] END AS kind FROM part""",
    "document_search": "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'the')",
}
