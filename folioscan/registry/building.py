"""Corpus building: pages, table-of-contents rows, blocks, sections, entries, revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions.text import compact_letters
from folioscan.operators import structure
from folioscan.operators.chunks import chunk
from folioscan.registry.common import CHUNKS, LIB, library, query, table
from folioscan.registry.retrieval import RELEVANT, relevance
from folioscan.sources import documents, html, library as libs

# --- pages (HTML has no SQL counterpart) ---------------------------------------------------------


@query("html_text")
def _text(spark, sf):
    return html.html_text(table(spark, sf, "pages"))


@query("html_blocks")
def _blocks(spark, sf):
    return html.html_blocks(table(spark, sf, "pages")).select("page_id", "pos", "kind", "level", "text")


@query("structure_signals")
def _signals(spark, sf):
    return html.structure_signals(table(spark, sf, "pages")).drop("heading_sample", "bold_label_sample")


TOC = """toc AS (
  SELECT page_id * 2 + k AS ord, split_part(url, '/', 3) AS host, CASE WHEN k = 0 THEN 'Page ' || page_id ELSE '' END AS name,
    CASE WHEN k = 0 THEN 'P/' || (page_id // 2) || '.html' ELSE 'p/' || (page_id // 2) || '.HTML' END AS local,
    CASE WHEN k = 0 THEN [split_part(url, '/', 3), 'Page ' || page_id] ELSE [split_part(url, '/', 3)] END AS path
  FROM pages, (SELECT unnest([0, 1]) AS k))"""


def _toc(spark, sf):
    """Every page as a nested sitemap list with a named and a nameless link to one of two pages' file."""
    p = table(spark, sf, "pages")
    host = F.split("url", "/")[2]
    half = F.floor(F.col("page_id") / 2).cast("string")

    def link(name, local):
        return F.concat(
            F.lit('<li><object type="text/sitemap"><param name="Name" value="'), name,
            F.lit('"><param name="Local" value="'), local, F.lit('"></object>'),
        )

    sitemap = F.concat(
        F.lit("<ul>"), link(host, F.lit("")), F.lit("<ul>"),
        link(F.concat(F.lit("Page "), "page_id"), F.concat(F.lit("\\P\\"), half, F.lit(".html#top"))),
        link(F.lit(""), F.concat(F.lit("/p/"), half, F.lit(".HTML"))), F.lit("</ul></ul>"),
    )
    rows = html.toc_entries(p.select("page_id", sitemap.alias("html")))
    return rows.withColumn("ord", F.col("page_id") * 2 + F.col("ord"))


@query("toc_entries", f"WITH {TOC} SELECT ord, name, local, array_to_string(path, ' > ') AS path FROM toc")
def _toc_entries(spark, sf):
    return _toc(spark, sf).select("ord", "name", "local", F.array_join("path", " > ").alias("path"))


CHOSEN = TOC + """,
chosen AS (SELECT * FROM (SELECT *, lower(local) AS key, row_number() OVER (PARTITION BY lower(local) ORDER BY len(path) DESC, ord) AS r FROM toc) WHERE r = 1)"""


@query("choose_toc_entries", f"WITH {CHOSEN} SELECT key, ord, name, local FROM chosen")
def _choose(spark, sf):
    return libs.choose_toc_entries(_toc(spark, sf)).select("key", "ord", "name", "local")


ASSEMBLED = CHOSEN + """,
docs_ AS (SELECT 'p/' || doc_id || '.html' AS key, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text, lang AS encoding,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS html_title FROM documents),
assembled AS (
  SELECT 'lib-' || substring(sha1(key), 1, 12) AS id, path[1] AS source_title, CASE WHEN name <> '' THEN name WHEN html_title <> '' THEN html_title ELSE regexp_replace(split_part(local, '/', 2), '\\.[^.]*$', '') END AS title,
    array_to_string(path, ' > ') AS full_path, text AS content, local AS source_file, encoding,
    CASE WHEN contains(upper(path[1]), 'CRB') THEN 'crb' WHEN contains(upper(path[1]), 'APG') THEN 'apg' WHEN contains(upper(path[1]), 'ACG') THEN 'acg' WHEN contains(upper(path[1]), 'ARG') THEN 'arg'
      WHEN contains(upper(path[1]), 'UM') THEN 'um' WHEN contains(upper(path[1]), 'UC') THEN 'uc' WHEN contains(upper(path[1]), 'OA') THEN 'oa' WHEN contains(upper(path[1]), 'UI') THEN 'ui'
      WHEN contains(upper(path[1]), 'FAQ') THEN 'faq' ELSE 'source-' || substring(sha1(path[1]), 1, 8) END AS source_id,
    CASE WHEN text IS NULL THEN 'missing' WHEN text = '' THEN 'empty' ELSE 'imported' END AS status
  FROM chosen LEFT JOIN docs_ USING (key))"""


def _assembled(spark, sf):
    d = table(spark, sf, "documents")
    pages = d.select(
        F.concat(F.lit("P/"), "doc_id", F.lit(".html")).alias("local"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("html_title"),
        F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("text"),
        F.col("lang").alias("encoding"),
    )
    return libs.assemble_documents(libs.choose_toc_entries(_toc(spark, sf)), pages, "lib", "v1")


@query(
    "assemble_documents",
    f"WITH {ASSEMBLED} SELECT id, source_id, source_title, title, full_path, length(content) AS content_length, source_file, status FROM assembled",
)
def _assemble(spark, sf):
    return _assembled(spark, sf).select(
        "id", "source_id", "source_title", "title", "full_path", F.length("content").alias("content_length"), "source_file", "status"
    )


@query("import_report", f"WITH {ASSEMBLED} SELECT status, coalesce(encoding, '-') AS encoding, count(*) AS files FROM assembled GROUP BY ALL")
def _report(spark, sf):
    return libs.import_report(_assembled(spark, sf))


@query(
    "remap_library",
    f"""WITH {ASSEMBLED} SELECT 'house:chm:' || substring(sha256(lower(source_file)), 1, 16) AS id, 'house' AS ruleset_id,
    'source-' || substring(sha256(source_title), 1, 12) AS source_id, '2e' AS version, title FROM assembled""",
)
def _remap(spark, sf):
    return libs.remap_library(_assembled(spark, sf), "house", "2e").select("id", "ruleset_id", "source_id", "version", "title")


# --- paged sources: each document as a page of its source -----------------------------------------

PAGED = """paged AS (SELECT source AS file, 'Book ' || source AS source_title, doc_id AS page, text AS raw_text, doc_id % 3 AS image_count FROM documents)"""


def _pages(spark, sf):
    d = table(spark, sf, "documents")
    cells = F.array(F.array(F.lit("a|b"), F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("c"), F.lit(" d  e "))))
    none = F.array().cast("array<array<array<string>>>")
    return d.select(
        F.col("source").alias("file"), F.concat(F.lit("Book "), "source").alias("source_title"),
        F.col("doc_id").alias("page"), F.col("text").alias("raw_text"), (F.col("doc_id") % 3).alias("image_count"),
        F.when(F.col("doc_id") % 5 == 0, F.array(cells)).otherwise(none).alias("tables"),
    )


_LAYOUT = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split(raw_text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


@query(
    "paged_documents",
    f"""WITH {PAGED}, t AS (SELECT *, {_LAYOUT} AS body, (SELECT any_value(lang) FROM documents d WHERE d.doc_id = page) AS lang FROM paged),
    c AS (SELECT *, CASE WHEN page % 5 = 0 THEN CASE WHEN body <> '' THEN body || chr(10) || chr(10) ELSE '' END || '### 表格 1' || chr(10) || chr(10) || '| a\\|b | ' || lang || ' |' || chr(10) || '| --- | --- |' || chr(10)
        || CASE WHEN page % 2 = 0 THEN '| c |  |' ELSE '| c | d e |' END ELSE body END AS content FROM t)
    SELECT 'lib:pdf:' || substring(sha256(file || ':' || page), 1, 16) AS id, source_title || ' · 第 ' || page || ' 页' AS title, content,
      CAST(CASE WHEN page % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS table_count FROM c WHERE content <> ''""",
)
def _paged(spark, sf):
    return libs.paged_documents(_pages(spark, sf), "lib", "1e").select("id", "title", "content", "table_count")


@query(
    "page_warnings",
    f"""WITH {PAGED}, t AS (SELECT *, {_LAYOUT} AS body FROM paged)
    SELECT file, page, 'unreliable_table' AS type, CAST(1 AS BIGINT) AS "table" FROM t WHERE page % 10 = 0
    UNION ALL SELECT file, page, 'image_dominant_page', NULL FROM t WHERE image_count > 0 AND length(body) < 80
    UNION ALL SELECT file, page, 'empty_page', NULL FROM t WHERE body = '' AND page % 5 <> 0""",
)
def _warnings(spark, sf):
    return libs.page_warnings(_pages(spark, sf))


HEADS = PAGED + """,
lines AS (SELECT file, page, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM (
  SELECT file, page, list_transform(string_split(replace(raw_text, '. ', '.' || chr(10) || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS l FROM paged)),
near AS (SELECT *, coalesce(lag(t) OVER w, '') AS b, coalesce(lead(t) OVER w, '') AS a FROM lines WINDOW w AS (PARTITION BY file, page ORDER BY line)),
kept AS (SELECT file, page, line, t AS heading FROM near WHERE t <> '' AND length(t) <= 32 AND b = '' AND a = ''
  AND NOT regexp_matches(t, '^[-|※]') AND NOT regexp_matches(t, '[。！？.!?；;]$') AND NOT regexp_matches(t, '^[\\d\\s/＋+－—-]+$')
  AND (NOT regexp_matches(t, '^\\d') OR regexp_matches(t, '^\\d+[.、]')) AND (length(t) <= 12 OR regexp_matches(t, '^(?:第.+[章节篇部]|\\d+(?:\\.\\d+)*[、.]?)') OR regexp_matches(t, '[《》【】]'))),
heads AS (SELECT file, page, heading, min(line) AS line, length(heading) <= 8 AND NOT regexp_matches(heading, '[《》【】（）()：:]') AS is_primary FROM kept GROUP BY ALL)"""


def _heads(spark, sf):
    """Sentence ends count as line ends here, or the prose would hold no short lines."""
    pages = _pages(spark, sf).withColumn("raw_text", F.replace("raw_text", F.lit(". "), F.lit(".\n\n")))
    pages = pages.withColumn("raw_text", F.regexp_replace("raw_text", r", ", ",\n\n"))
    return pages, structure.page_headings(pages)


HEADS = HEADS.replace("replace(raw_text, '. ', '.' || chr(10) || chr(10))", "replace(replace(raw_text, '. ', '.' || chr(10) || chr(10)), ', ', ',' || chr(10) || chr(10))")


@query("page_headings", f"WITH {HEADS} SELECT file, page, line, heading, is_primary FROM heads")
def _page_headings(spark, sf):
    return _heads(spark, sf)[1].select("file", "page", "line", "heading", F.col("primary").alias("is_primary"))


PAGE_BLOCKS = HEADS + f""",
laid AS (SELECT p.*, (SELECT any_value(lang) FROM documents d WHERE d.doc_id = p.page) AS lang, {_LAYOUT} AS body
  FROM (SELECT * REPLACE (replace(replace(raw_text, '. ', '.' || chr(10) || chr(10)), ', ', ',' || chr(10) || chr(10)) AS raw_text) FROM paged) p),
full_ AS (SELECT file, page, source_title, CASE WHEN page % 5 = 0 THEN CASE WHEN body <> '' THEN body || chr(10) || chr(10) ELSE '' END || '### 表格 1' || chr(10) || chr(10) || '| a\\|b | ' || lang || ' |' || chr(10) || '| --- | --- |' || chr(10)
    || CASE WHEN page % 2 = 0 THEN '| c |  |' ELSE '| c | d e |' END ELSE body END AS content FROM laid),
rows_ AS (SELECT file, page, source_title, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM (SELECT *, string_split(content, chr(10)) AS l FROM full_ WHERE content <> '')),
marked AS (SELECT r.*, h.heading IS NOT NULL AS hit, coalesce(h.is_primary, false) AS top FROM rows_ r LEFT JOIN heads h ON h.file = r.file AND h.page = r.page AND h.heading = r.t),
held AS (
  SELECT *, sum(hit::INT) OVER (PARTITION BY file, page ORDER BY line) AS blk,
    last_value(CASE WHEN hit AND top THEN t END IGNORE NULLS) OVER w AS v1, max(CASE WHEN hit AND top THEN page * 1000000 + line END) OVER w AS a1,
    last_value(CASE WHEN hit AND NOT top THEN t END IGNORE NULLS) OVER w AS v2, max(CASE WHEN hit AND NOT top THEN page * 1000000 + line END) OVER w AS a2
  FROM marked WINDOW w AS (PARTITION BY file ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
placed AS (SELECT *, concat_ws(' > ', source_title, v1, CASE WHEN a1 IS NULL OR a2 > a1 THEN v2 END) AS path FROM held),
cut AS (
  SELECT file, page, any_value(source_title) AS source_title, blk, arg_min(path, line) AS path,
    regexp_replace(string_agg(t, chr(10) ORDER BY line), '^\\s+|\\s+$', '', 'g') AS content FROM placed GROUP BY file, page, blk),
ends AS (SELECT file, page, arg_max(path, line) || ' > 第 ' || page || ' 页' AS full_path FROM placed GROUP BY file, page),
page_docs AS (
  SELECT 'lib:pdf:' || substring(sha256(file || ':' || page), 1, 16) AS id, source_title || ' · 第 ' || page || ' 页' AS title, full_path, page, path, content, blk
  FROM cut JOIN ends USING (file, page) WHERE content <> '')"""


def _page_docs(spark, sf):
    """The pages with short lines, so that there are headings to carry from page to page."""
    return libs.paged_documents(_heads(spark, sf)[0], "lib", "1e")


@query(
    "paged_blocks",
    f"WITH {PAGE_BLOCKS} SELECT id, full_path, row_number() OVER (PARTITION BY id ORDER BY blk) - 1 AS block, path, content FROM page_docs",
)
def _paged_blocks(spark, sf):
    docs = _page_docs(spark, sf).select("id", "full_path", F.posexplode("structural_blocks").alias("block", "b"))
    return docs.select("id", "full_path", "block", F.array_join("b.heading_path", " > ").alias("path"), "b.content")


@query(
    "paged_block_chunks",
    f"""WITH {PAGE_BLOCKS},
    windows AS (SELECT id, title, path, blk, s, substring(content, s + 1, 500) AS content FROM (
      SELECT *, unnest(range(0, greatest(length(content), 1), 450)) AS s, length(content) AS n FROM page_docs) WHERE s = 0 OR s < n - 50)
    SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY blk, s) - 1 AS chunk_index, content, concat_ws(chr(10), title, path, content) AS search_text FROM windows""",
)
def _paged_block_chunks(spark, sf):
    """Blocks feed the chunks: one numbering over the blocks of a page, each chunk under its block's path."""
    return chunk(_page_docs(spark, sf)).select("doc_id", "chunk_index", "content", "search_text")


@query(
    "page_contexts",
    f"""WITH {HEADS}, top AS (SELECT p.file, p.page, arg_max(h.heading, struct_pack(a := h.page, b := h.line)) FILTER (is_primary) AS "primary",
        max(struct_pack(a := h.page, b := h.line)) FILTER (is_primary) AS at_top,
        arg_max(h.heading, struct_pack(a := h.page, b := h.line)) FILTER (NOT is_primary) AS sub, max(struct_pack(a := h.page, b := h.line)) FILTER (NOT is_primary) AS at_sub
      FROM paged p LEFT JOIN heads h ON h.file = p.file AND h.page <= p.page GROUP BY p.file, p.page)
    SELECT file, page, "primary", CASE WHEN at_top IS NULL OR at_sub > at_top THEN sub END AS subsection FROM top""",
)
def _contexts(spark, sf):
    pages, heads = _heads(spark, sf)
    return structure.page_contexts(heads, pages)


# --- blocks: the lines of each document; short ones are headings, some long ones tables ------------


def blocks(spark, sf):
    d = table(spark, sf, "documents")
    n = F.length("text")
    lines = d.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")).alias("pos", "text"),
    )
    heading = n <= 60
    is_table = ~heading & (n % 7 == 0)
    return lines.select(
        "doc_id",
        "pos",
        F.when(heading, "heading").when(is_table, "table").otherwise("paragraph").alias("kind"),
        F.when(heading, n % 6 + 1).otherwise(0).alias("level"),
        "text",
        F.when(is_table, F.array(F.split("text", ", "), F.split("text", r"\. "))).alias("rows"),
    )


BLOCKS = LIB + """,
ln AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS l FROM documents)),
blocks AS (SELECT *, CASE WHEN length(text) <= 60 THEN 'heading' WHEN length(text) % 7 = 0 THEN 'table' ELSE 'paragraph' END AS kind,
  CASE WHEN length(text) <= 60 THEN length(text) % 6 + 1 ELSE 0 END AS level FROM ln),
hd AS (SELECT doc_id, pos, level, text FROM blocks WHERE kind = 'heading'),
live AS (
  SELECT doc_id, pos, text, coalesce((SELECT min(n.pos) FROM hd n WHERE n.doc_id = h.doc_id AND n.pos > h.pos AND n.level <= h.level), 1000000000) AS until FROM hd h),
paths AS (
  SELECT b.doc_id, b.pos, coalesce(list(l.text ORDER BY l.pos) FILTER (l.text IS NOT NULL), []) AS path
  FROM blocks b LEFT JOIN live l ON l.doc_id = b.doc_id AND l.pos <= b.pos AND b.pos < l.until GROUP BY ALL)"""


@query("heading_paths", f"WITH {BLOCKS} SELECT doc_id, pos, array_to_string(path, ' > ') AS path FROM paths")
def _paths(spark, sf):
    return structure.heading_paths(blocks(spark, sf)).select("doc_id", "pos", F.array_join("path", " > ").alias("path"))


SECTIONS = BLOCKS + """,
num AS (SELECT b.*, path, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS s FROM blocks b JOIN paths USING (doc_id, pos)),
sec AS (SELECT doc_id, s, arg_min(path, pos) AS path, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS content
  FROM num GROUP BY doc_id, s HAVING bool_or(kind <> 'heading')),
secs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS section FROM sec)"""


@query("sections", f"WITH {SECTIONS} SELECT doc_id, section, array_to_string(path, ' > ') AS path, content FROM secs")
def _sections(spark, sf):
    return structure.sections(blocks(spark, sf)).withColumn("path", F.array_join("path", " > "))


_C = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
CHILDREN = SECTIONS + f""",
j AS (SELECT secs.*, title, full_path, list_transform(path, lambda x: {_C.format("x")}) AS cp,
    list_transform(list_concat([title], string_split(full_path, ' > ')), lambda x: {_C.format("x")}) AS known,
    list_filter(list_transform(string_split(secs.content, chr(10)), lambda x: {_C.format("x")}), lambda x: x <> '') AS ls
  FROM secs JOIN lib ON lib.id = secs.doc_id),
j2 AS (SELECT *, coalesce(list_min(list_filter(range(1, len(cp) + 1), lambda i: NOT list_contains(known, cp[i]))), 1000000) AS i0 FROM j
  WHERE content <> '' AND NOT (length(content) <= 80 AND len(ls) > 0 AND len(list_filter(ls, lambda x: NOT list_contains(known, x) AND NOT list_contains(cp, x))) = 0)),
j3 AS (SELECT *, list_filter(path, lambda x, i: i >= i0 AND (i = i0 OR cp[i] <> cp[i - 1])) AS suffix FROM j2)"""


@query(
    "section_documents",
    f"""WITH {CHILDREN} SELECT doc_id AS legacy_parent_id, section AS ord, coalesce(suffix[-1], title) AS title,
      array_to_string(list_concat([full_path], suffix), ' > ') AS full_path, length(content) AS content_length FROM j3""",
)
def _section_documents(spark, sf):
    out = structure.section_documents(library(spark, sf), structure.sections(blocks(spark, sf)))
    return out.select("legacy_parent_id", "ord", "title", "full_path", F.length("content").alias("content_length"))


@query(
    "table_row_blocks",
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS table_index,
      array_to_string(string_split(text, ', '), ' | ') AS h, array_to_string(string_split(text, '. '), ' | ') AS r, string_split(text, ', ') AS a, string_split(text, '. ') AS b FROM blocks WHERE kind = 'table')
    SELECT doc_id, table_index, CAST(1 AS BIGINT) AS row_index, CASE WHEN a <> b THEN h || chr(10) || r ELSE r END AS content FROM t""",
)
def _rows(spark, sf):
    return structure.table_row_blocks(blocks(spark, sf))


def _catalog(spark, sf):
    """Documents whose path names an entry category, and blocks with labelled fields and bilingual titles."""
    kinds = F.array(*[F.lit(k) for k in ("Spells", "Feats", "Magic Items", "Class Features")])
    num = F.col("id").cast("bigint")
    docs = library(spark, sf).withColumn(
        "full_path", F.concat_ws(" > ", "full_path", F.element_at(kinds, (num % 4 + 1).cast("int")))
    )
    n = F.length("text")
    label = F.when(n % 5 == 0, "School: ").when(n % 5 == 1, "Benefit: ").when(n % 5 == 2, "Aura: ").otherwise("")
    base = blocks(spark, sf)
    titled = F.when((F.col("kind") == "paragraph") & (n % 3 == 0) & (n <= 150), F.concat(F.lit("条目 ("), F.substring("text", 1, 20), F.lit(")")))
    return docs, base.withColumn(
        "text", F.coalesce(titled, F.when(F.col("kind") == "paragraph", F.concat(label, "text")).otherwise(F.col("text")))
    )


@query("entry_spans")
def _spans(spark, sf):
    docs, rows = _catalog(spark, sf)
    return structure.entry_spans(docs, rows).withColumn("path", F.array_join("path", " > "))


@query("entry_documents")
def _entry_documents(spark, sf):
    docs, rows = _catalog(spark, sf)
    spans = structure.split_oversized_entries(structure.entry_spans(docs, rows), rows)
    return structure.entry_documents(docs, spans).withColumn("heading_path", F.array_join("heading_path", " > "))


@query("table_documents")
def _table_documents(spark, sf):
    docs, rows = _catalog(spark, sf)
    return structure.table_documents(docs, rows, structure.entry_spans(docs, rows)).withColumn(
        "heading_path", F.array_join("heading_path", " > ")
    )


@query("overview_documents")
def _overview(spark, sf):
    docs, rows = _catalog(spark, sf)
    return structure.overview_documents(docs, rows, structure.entry_spans(docs, rows), 1_000).withColumn(
        "heading_path", F.array_join("heading_path", " > ")
    )


@query(
    "entry_names",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN '条目' END AS zh,
      CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN source || ' / ' || lang ELSE lang END AS en FROM documents""",
)
def _names(spark, sf):
    num = F.col("doc_id") % 3
    title = (
        F.when(num == 0, F.concat(F.lit("条目 （"), "source", F.lit("）")))
        .when(num == 1, F.concat_ws(" / ", "source", "lang"))
        .otherwise(F.col("lang"))
    )
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), structure.entry_names(title).alias("n"))
    return d.select("id", "n.zh", "n.en")


@query(
    "classify_entries",
    """WITH c AS (SELECT doc_id, source || ' ' || lang AS ctx, CASE doc_id % 6 WHEN 0 THEN 'School: x Range: y' WHEN 1 THEN 'Benefit - ' WHEN 2 THEN 'Aura: z Price: 3' WHEN 3 THEN 'Replaces: a' WHEN 4 THEN 'Level: 3 Description: x' ELSE '' END AS f FROM documents),
    r AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'spell' WHEN 1 THEN 'feat' WHEN 2 THEN 'magic_item' WHEN 4 THEN 'class_ability' END AS t FROM c)
    SELECT coalesce(t, 'none') AS entry_type, count(*) AS entries FROM r GROUP BY ALL""",
)
def _classify(spark, sf):
    fields = F.array(*[F.lit(v) for v in ("school: x range: y ", "benefit - ", "aura: z price: 3 ", "replaces: a ", "level: 3 description: x ", "")])
    d = table(spark, sf, "documents")
    body = F.concat(F.element_at(fields, (F.col("doc_id") % 6 + 1).cast("int")), F.lower("text"))
    kind = structure.classify_entry(F.concat_ws(" ", "source", "lang"), F.col("source"), body)
    return d.groupBy(F.coalesce(kind, F.lit("none")).alias("entry_type")).agg(F.count("*").alias("entries"))


SIGNALS = BLOCKS + """,
sg AS (SELECT doc_id, count(*) FILTER (kind = 'heading') AS h, count(*) FILTER (kind = 'table') AS t, count(*) FILTER (kind = 'paragraph') AS bold FROM blocks WHERE CAST(doc_id AS BIGINT) % 10 > 0 GROUP BY doc_id),
au AS (SELECT id AS doc_id, full_path, length(content) AS n, coalesce(h, 0) AS h, coalesce(t, 0) AS t, coalesce(bold, 0) AS bold, sg.doc_id IS NULL AS missing_source FROM lib LEFT JOIN sg ON sg.doc_id = lib.id),
audit AS (SELECT *, CASE WHEN n <= 4000 AND t > 0 THEN 'keep_table_aware' WHEN n <= 4000 THEN 'keep' WHEN contains(full_path, 'src1') AND n >= 20000 AND bold >= 20 THEN 'split_catalog_entries'
  WHEN h >= 2 AND t > 0 THEN 'split_headings_and_tables' WHEN h >= 2 THEN 'split_headings' WHEN t > 0 THEN 'split_tables_with_context' WHEN n >= 10000 THEN 'manual_pattern_review' ELSE 'keep' END AS strategy,
  greatest(1, CAST(ceil(greatest(n - 50, 1) / 450.0) AS BIGINT)) AS chunk_estimate, greatest(1, CAST(ceil(n / 8000.0) AS BIGINT)) AS minimum_parents FROM au)"""


def _audit(spark, sf):
    """Paragraph counts stand for bold labels; every tenth source file is missing."""
    b = blocks(spark, sf).where(F.col("doc_id").cast("bigint") % 10 > 0)
    signals = b.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "heading").alias("heading_count"),
        F.count_if(F.col("kind") == "table").alias("table_count"),
        F.count_if(F.col("kind") == "paragraph").alias("bold_label_count"),
    )
    return structure.structure_audit(library(spark, sf), signals, ("src1",))


@query("structure_audit", f"WITH {SIGNALS} SELECT doc_id, strategy, missing_source, chunk_estimate, minimum_parents FROM audit")
def _structure_audit(spark, sf):
    return _audit(spark, sf).select("doc_id", "strategy", "missing_source", "chunk_estimate", "minimum_parents")


@query(
    "audit_summary",
    f"""WITH {SIGNALS} SELECT strategy, count(*) AS documents, count(*) FILTER (missing_source) AS missing_sources, min(n) AS minimum_length, max(n) AS maximum_length,
    round(avg(n), 2) AS average_length, count(*) FILTER (n > 4000) AS over_4000, count(*) FILTER (n > 10000) AS over_10000, count(*) FILTER (n > 50000) AS over_50000 FROM audit GROUP BY strategy""",
)
def _audit_summary(spark, sf):
    return structure.audit_summary(_audit(spark, sf))


@query(
    "evaluation_targets",
    f"""WITH {SIGNALS}, {RELEVANT}, asked AS (SELECT case_id, doc_id FROM rel UNION ALL SELECT DISTINCT case_id, 'no such document' FROM rel),
    placed AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) - 1 AS position FROM asked)
    SELECT case_id, position, placed.doc_id, n AS content_length, coalesce(strategy, 'missing') AS strategy FROM placed LEFT JOIN audit USING (doc_id)""",
)
def _targets(spark, sf):
    """Each case lists its documents and one that the library lacks."""
    found = relevance(spark, sf).groupBy("case_id").agg(F.array_sort(F.array_append(F.collect_set("doc_id"), "no such document")).alias("relevant_ids"))
    return structure.evaluation_targets(found, _audit(spark, sf)).select("case_id", "position", "doc_id", "content_length", "strategy")


@query("transform_corpus")
def _transform(spark, sf):
    docs, rows = _catalog(spark, sf)
    out = structure.transform_corpus(docs, rows, _audit(spark, sf))
    return out.select(
        "id", "legacy_parent_id", "origin", "entry_type", "title", "full_path", F.length("content").alias("content_length"),
        F.length(compact_letters(F.col("content"))).alias("compact_length"),
    )


# --- cases, revisions, vectors ---------------------------------------------------------------------


@query(
    "expand_history",
    """WITH h AS (SELECT conv_id AS id, count(*) AS n, arg_min(text, turn) AS u, arg_max(text, turn) AS a FROM conversations GROUP BY conv_id),
    t AS (SELECT *, unnest(range(1, n + 1)) AS turn FROM h)
    SELECT id, (turn - 1) * 2 AS position, 'user' AS role, CASE WHEN turn = 1 THEN 'first' ELSE u END AS content FROM t
    UNION ALL SELECT id, (turn - 1) * 2 + 1, 'assistant', CASE WHEN turn = n AND n > 1 THEN 'last' ELSE a END FROM t""",
)
def _expand(spark, sf):
    """Each conversation becomes a template: its length, first and last text as filler, two events."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").cast("int").alias("turn_count"), F.min_by("text", "turn").alias("filler_user"), F.max_by("text", "turn").alias("filler_assistant")
    )
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(1).alias("turn"), F.lit("first").alias("user"), none.alias("assistant"))
    last = F.struct(F.col("turn_count").alias("turn"), none.alias("user"), F.lit("last").alias("assistant"))
    events = F.when(F.col("turn_count") > 1, F.array(first, last)).otherwise(F.array(first))
    return documents.expand_history(c.withColumn("events", events).withColumnRenamed("conv_id", "id"))


@query(
    "current_revision",
    """SELECT event_type AS library_id, arg_max(strftime(ts, '%Y%m%dT%H%M%SZ'), struct_pack(a := ts, b := event_id)) AS revision FROM events GROUP BY event_type""",
)
def _current(spark, sf):
    e = table(spark, sf, "events")
    return libs.current_revision(
        e.select(
            F.col("event_type").alias("library_id"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("revision"),
            F.struct("ts", "event_id").alias("activated_at"),
        )
    )


@query(
    "new_chunk_vectors",
    f"""WITH {CHUNKS}, num AS (SELECT *, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT), chunk_index) - 1 AS r FROM chunks)
    SELECT chunk_id, doc_id, chunk_index, source_id, vec_id FROM chunks JOIN embeddings ON vec_id = CAST(doc_id AS BIGINT) * 2 + chunk_index AND chunk_index < 2
    WHERE chunk_index > 0""",
)
def _vectors(spark, sf):
    """The first two chunks of early documents have vectors; the first ones are already stored."""
    chunks = chunk(library(spark, sf))
    key = F.format_string("%d:%05d", F.floor(F.col("vec_id") / 2), F.col("vec_id") % 2)
    vectors = table(spark, sf, "embeddings").select(key.alias("chunk_id"), "vec_id", "embedding")
    stored = chunks.where(F.col("chunk_index") == 0)
    return libs.new_chunk_vectors(chunks, vectors, stored).select("chunk_id", "doc_id", "chunk_index", "source_id", "vec_id")
