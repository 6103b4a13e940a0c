"""Element queries: HTML pages -> typed elements; tagged text round trip; filters; assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtide.operators import elements as E
from ragtide.plans.registry import register
from ragtide.sources.tables import table

# ------------------------------------------------------------------ SQL building blocks
# Independent DuckDB statement of P1: same regexes (RE2 has no look-around), strings split
# with list functions, one row per element.
SQL_ELEMENTS = r"""
c AS (
  SELECT page_id AS doc,
         regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS h
  FROM pages
), n AS (
  SELECT doc, array_to_string(list_transform(string_split(h, '</nav>'),
           lambda s: split_part(s, '<nav', 1)
                     || regexp_replace(substr(s, length(split_part(s, '<nav', 1)) + 1), '(?i)<li\b', '<navli', 'g')),
         '</nav>') AS h
  FROM c
), m AS (
  SELECT doc, string_split(chr(2) || regexp_replace(h,
    '(?i)<(/?(?:title|h[1-6]|p|li|navli|footer|table|div|pre|blockquote|section|article|aside|main|header|nav|ul|ol|dl|dt|dd|form|figure|figcaption|head|body|html))(?:\s[^>]*)?/?>',
    chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts
  FROM n
), pc AS (
  SELECT doc, unnest(parts) AS piece, unnest(range(0, len(parts))) AS pos FROM m
), el0 AS (
  SELECT doc, pos, lower(split_part(piece, chr(2), 1)) AS tag, substr(piece, strpos(piece, chr(2)) + 1) AS cut FROM pc
), el AS (
  SELECT doc, pos,
         CASE WHEN tag = 'title' OR (len(tag) = 2 AND tag[1] = 'h' AND tag[2] BETWEEN '1' AND '6') THEN 'Title'
              WHEN tag = 'p' THEN 'NarrativeText'
              WHEN tag = 'li' THEN 'ListItem' WHEN tag = 'navli' THEN 'Header' WHEN tag = 'footer' THEN 'Footer'
              WHEN tag = 'table' THEN 'Table' ELSE 'Uncategorized' END AS category,
         trim(regexp_replace(
           replace(replace(replace(replace(replace(replace(regexp_replace(cut, '<[^>]*>', ' ', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
           '[\t\n\f\r ]+', ' ', 'g')) AS text
  FROM el0
), elements AS (SELECT * FROM el WHERE text <> '')"""

# The tagged-text writer's inverse, stated directly on document lines: line i (0-based)
# is element i + 1, category by i % 5, page i // 10 + 1 (N/A when i % 7 = 6).
SQL_LINES = r"""
ls AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM ls),
tagged AS (
  SELECT doc, i + 1 AS pos, ['Title', 'NarrativeText', 'ListItem', 'Table', 'Footer'][i % 5 + 1] AS category,
         CASE WHEN i % 7 = 6 THEN NULL ELSE i // 10 + 1 END AS page, line AS text
  FROM l
)"""

SQL_FORMAT = r"""
fmt AS (
  SELECT doc, pos, category,
         CASE WHEN category = 'Table'
                THEN chr(10) || '=== TABLE (page ' || coalesce(CAST(page AS VARCHAR), 'N/A') || ') ===' || chr(10) || text
              WHEN category IN ('Title', 'NarrativeText', 'ListItem')
                THEN chr(10) || '[' || category || '] (page ' || coalesce(CAST(page AS VARCHAR), 'N/A') || ')'
                     || chr(10) || text || chr(10)
         END AS formatted
  FROM tagged
)"""


def _html_elements(spark, d):
    return E.extract_elements(table(spark, d, "pages"))


def _tagged_elements(spark, d):
    return E.parse_tagged(E.tagged_corpus(table(spark, d, "documents")))


@register("extract_elements", "WITH " + SQL_ELEMENTS + """
SELECT doc, pos, category, text FROM elements""")
def extract_elements(spark, d):
    """Typed elements from every HTML page (script/style/comments stripped first)."""
    return _html_elements(spark, d).select("doc", "pos", "category", "text")


@register("element_coverage", r"""
SELECT page_id AS doc, CAST(length(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\t\n\f\r ]+', '', 'g')) AS BIGINT) AS n_visible
FROM pages WHERE html IS NOT NULL""")
def element_coverage(spark, d):
    """P1 check: the elements of a page hold every visible character of it (tags and blanks aside)."""
    n = F.length(F.regexp_replace("text", r"[\t\n\f\r ]+", ""))
    pages = table(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("doc"))
    found = _html_elements(spark, d).groupBy("doc").agg(F.sum(n).alias("n_visible"))
    return pages.join(found, "doc", "left").select("doc", F.coalesce("n_visible", F.lit(0)).cast("bigint").alias("n_visible"))


@register("parse_tagged", "WITH " + SQL_LINES + """
SELECT doc, pos, category, page, text FROM tagged""")
def parse_tagged(spark, d):
    """Documents written as tagged blocks and parsed back; must give one element per line."""
    return _tagged_elements(spark, d).select("doc", "pos", "category", "page", "text")


@register("filter_elements_allow", "WITH " + SQL_ELEMENTS + """
SELECT doc, pos, category FROM elements WHERE category IN ('Table', 'Title', 'NarrativeText', 'ListItem')""")
def filter_elements_allow(spark, d):
    """P3 allow-list (notebook rule) over the HTML elements."""
    return E.filter_allow(_html_elements(spark, d)).select("doc", "pos", "category")


@register("filter_elements_deny", "WITH " + SQL_ELEMENTS + """
SELECT doc, pos, category FROM elements WHERE coalesce(category, '') NOT IN ('Header', 'Footer', 'PageBreak')""")
def filter_elements_deny(spark, d):
    """P3 deny-list (ingestion rule) over the HTML elements; NULL category kept."""
    return E.filter_deny(_html_elements(spark, d)).select("doc", "pos", "category")


@register("format_elements", "WITH " + SQL_LINES + "," + SQL_FORMAT + """
SELECT doc, pos, category, formatted FROM fmt""")
def format_elements(spark, d):
    """Tagged block text per element (NULL outside the allow-list; tables fall back to text)."""
    return E.format_elements(_tagged_elements(spark, d))


@register("assemble_documents", "WITH " + SQL_LINES + "," + SQL_FORMAT + """
SELECT doc, md5(string_agg(formatted, chr(10) ORDER BY pos)) AS text_md5,
       CAST(sum(length(formatted)) + count(*) - 1 AS BIGINT) AS n_chars, count(*) AS n_elements
FROM fmt WHERE formatted IS NOT NULL GROUP BY doc""")
def assemble_documents(spark, d):
    """P5 (tagged style): one text per document from its ordered, formatted elements."""
    a = E.assemble_documents(_tagged_elements(spark, d), style="tagged")
    return a.select("doc", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "n_elements")


@register("assemble_documents_plain", "WITH " + SQL_ELEMENTS + """
SELECT doc, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS text_md5, count(*) AS n_elements
FROM elements WHERE coalesce(category, '') NOT IN ('Header', 'Footer', 'PageBreak') GROUP BY doc""")
def assemble_documents_plain(spark, d):
    """P5 (ingestion style): deny-list, bare element text joined by blank lines."""
    a = E.assemble_documents(_html_elements(spark, d), style="plain")
    return a.select("doc", F.md5("text").alias("text_md5"), "n_elements")


@register("element_stats", "WITH " + SQL_ELEMENTS + """
SELECT doc, CAST(count_if(category = 'Table') AS BIGINT) AS "Table",
       CAST(count_if(category = 'Title') AS BIGINT) AS Title,
       CAST(count_if(category = 'NarrativeText') AS BIGINT) AS NarrativeText,
       CAST(count_if(category = 'ListItem') AS BIGINT) AS ListItem,
       CAST(count_if(coalesce(category, '') NOT IN ('Table', 'Title', 'NarrativeText', 'ListItem')) AS BIGINT) AS ignored
FROM elements GROUP BY doc""")
def element_stats(spark, d):
    """Per-page counts of kept categories and of everything else."""
    return E.element_stats(_html_elements(spark, d))


@register("file_names", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
n AS (SELECT page_id, path, split_part(path, '/', -1) AS file_name FROM p)
SELECT page_id, path, file_name, regexp_replace(file_name, '\.[^./]*$', '') AS stem,
       regexp_replace(file_name, '\.[^./]*$', '') || '.txt' AS txt_name
FROM n""")
def file_names(spark, d):
    """Path, file name, stem and parsed-text name of every page URL."""
    return E.file_names(table(spark, d, "pages"), key="page_id")


@register("previews", """
SELECT doc_id, substr(text, 1, 100) AS preview_100, substr(text, 1, 80) AS preview_80,
       substr(text, 1, 300) || '...' AS answer_preview, substr(text, 1, 60) AS preview_60
FROM documents""")
def previews(spark, d):
    """Fixed-length previews (code points) of every document."""
    return E.previews(table(spark, d, "documents"), key="doc_id")


@register("page_furniture", "WITH " + SQL_ELEMENTS + r""",
site AS (SELECT page_id AS doc, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS site FROM pages),
keyed AS (
  SELECT e.doc, e.pos, e.category, s.site, trim(regexp_replace(lower(e.text), '[^\p{L}]+', ' ', 'g')) AS k,
         max(e.pos) OVER (PARTITION BY e.doc) AS last
  FROM elements e JOIN site s USING (doc)
), once AS (
  SELECT site, k, doc, min(pos / greatest(last, 1)) AS place FROM keyed WHERE k <> '' AND site <> '' GROUP BY ALL
), np AS (SELECT site, count(DISTINCT doc) AS pages FROM site GROUP BY site),
rep AS (
  SELECT site, k, CASE WHEN avg(place) < 0.5 THEN 'Header' ELSE 'Footer' END AS furniture
  FROM once JOIN np USING (site) GROUP BY site, k, pages HAVING count(*) >= 5 AND count(*) >= 0.5 * pages
)
SELECT keyed.doc, keyed.pos, coalesce(rep.furniture, keyed.category) AS category
FROM keyed LEFT JOIN rep ON rep.site = keyed.site AND rep.k = keyed.k""")
def page_furniture(spark, d):
    """Blocks that most pages of a host repeat become Header or Footer, whatever their tag."""
    host = F.lower(F.regexp_extract("url", r"://([^/:?#]+)", 1))
    sites = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.nullif(host, F.lit("")).alias("site"))
    return E.furniture(_html_elements(spark, d), sites).select("doc", "pos", "category")
