"""Text-cleaning queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions import text as t
from ragmill.operators import documents as d
from ragmill.plans import query
from ragmill.tables import sql, table

# Documents with control characters, marks and tags put in between.
DIRTY_SQL = """SELECT doc_id, chr(91) || CAST(doc_id AS STRING) || chr(93) || ' x' || chr(13) || chr(10) || chr(7) || text || chr(127) || chr(13)
  || chr(91) || '12345' || chr(93) || ' </Documents> < DOCUMENT x <documented' AS text FROM {documents}"""
CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\x7F\x80-\x9f]"
LF = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"


@query(f"WITH d AS ({DIRTY_SQL}) SELECT doc_id, md5(regexp_replace(text, '{CONTROL}', '', 'g')) AS text_md5 FROM d")
def strip_control(spark, sf):
    return sql(spark, sf, DIRTY_SQL).select("doc_id", F.md5(t.strip_control(F.col("text"))).alias("text_md5"))


@query(f"""WITH d AS ({DIRTY_SQL}) SELECT doc_id, md5(regexp_replace(regexp_replace({LF}, '{CONTROL}', '', 'g'), '(?m)^\\[(\\d\\d?\\d?\\d?)\\]', '［\\1］', 'g')) AS text_md5 FROM d""")
def neutralize_markers(spark, sf):
    return sql(spark, sf, DIRTY_SQL).select("doc_id", F.md5(t.neutralize_markers(F.col("text"))).alias("text_md5"))


@query(f"""WITH d AS ({DIRTY_SQL}) SELECT doc_id, md5(regexp_replace(regexp_replace({LF}, '{CONTROL}', '', 'g'), '(?i)<(/?\\s*documents?[\\s>])', '&lt;\\1', 'g')) AS text_md5 FROM d""")
def neutralize_document_tags(spark, sf):
    return sql(spark, sf, DIRTY_SQL).select("doc_id", F.md5(t.neutralize_document_tags(F.col("text"))).alias("text_md5"))


URL_NAME_SQL = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN chr(9) || ' ' WHEN page_id % 5 = 1 THEN '../' || url || url || '.pdf' ELSE url || chr(9) || '<\"A&B\">' || chr(1) || url END AS name FROM {pages}"
SPACED = "trim(regexp_replace(regexp_replace(regexp_replace(name, '[\\t\\n\\r]', ' ', 'g'), '[\\x00-\\x1F\\x7F\x80-\x9f]', '', 'g'), '[\\s　]+', ' ', 'g'))"


@query(f"""WITH n AS ({URL_NAME_SQL}), c AS (SELECT page_id, substr({SPACED}, 1, 100) AS c FROM n)
SELECT page_id, CASE WHEN c = '' THEN '(名前なし)' ELSE replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END AS name FROM c""")
def clean_name(spark, sf):
    return sql(spark, sf, URL_NAME_SQL).select("page_id", t.clean_name(F.col("name")).alias("name"))


@query(f"""WITH n AS ({URL_NAME_SQL}), c AS (SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(name, '[\\x00-\\x1F\\x7F\x80-\x9f]', '', 'g'), '[/\\\\]', '_', 'g'), '[\\s　]+', ' ', 'g')), '^\\.+', '')) AS c FROM n),
e AS (SELECT *, CASE WHEN length(regexp_extract(c, '(\\.[^.]*)$', 1)) BETWEEN 1 AND 16 AND length(regexp_extract(c, '(\\.[^.]*)$', 1)) < length(c) THEN regexp_extract(c, '(\\.[^.]*)$', 1) ELSE '' END AS ext FROM c)
SELECT page_id, CASE WHEN c = '' THEN 'file' WHEN length(c) > 120 THEN substr(c, 1, 120 - length(ext)) || ext ELSE c END AS name FROM e""")
def object_name(spark, sf):
    return sql(spark, sf, URL_NAME_SQL).select("page_id", t.object_name(F.col("name"), "file").alias("name"))


@query("SELECT doc_id, md5(substr(text, 1, 500)) AS text_md5, length(text) > 500 AS cut FROM documents")
def cut_chars(spark, sf):
    cut = t.cut_chars(F.col("text"), 500)
    return table(spark, sf, "documents").select("doc_id", F.md5(cut["text"]).alias("text_md5"), cut["cut"].alias("cut"))


@query("SELECT conv_id, turn, md5(text || '　é <0xFF>') AS text_md5 FROM conversations")
def decode_byte_tokens(spark, sf):
    """Texts followed by byte tokens: a space, a letter, and a byte that forms nothing."""
    text = F.concat("text", F.lit("<0xE3><0x80><0x80><0xC3><0xa9> <0xFF>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t.decode_byte_tokens(text)).alias("text_md5"))


SPACED_SQL = "SELECT conv_id, turn, '値 は　' || CAST(turn AS STRING) || ' です AB cd 。 ' || text AS text FROM {conversations}"


@query(
    """SELECT conv_id, turn, md5(regexp_replace(regexp_replace('値 は　' || turn || ' です AB cd 。 ' || text, '([値はです。　])[\\s　]+', '\\1', 'g'), '[\\s　]+([値はです。　])', '\\1', 'g')) AS text_md5 FROM conversations""")
def remove_japanese_spaces(spark, sf):
    return sql(spark, sf, SPACED_SQL).select("conv_id", "turn", F.md5(t.remove_japanese_spaces(F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US' ELSE ' ' || upper(lang) || ' ' END AS code FROM documents")
def map_language(spark, sf):
    spoken = F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", t.map_language(spoken).alias("code"))


SEGMENT_SQL = "SELECT conv_id AS job, turn AS pos, '  ' || text || chr(10) AS text, CASE WHEN conv_id % 3 = 0 THEN 'French' ELSE 'english' END AS language FROM {conversations}"


@query(f"""WITH s AS ({SEGMENT_SQL}) SELECT job, CASE max(language) WHEN 'english' THEN 'en-US' ELSE max(language) END AS language_code,
  md5(regexp_replace(regexp_replace(string_agg(text, '' ORDER BY pos), '^[\\s　]+|[\\s　]+$', '', 'g'), '[\\s　]+', ' ', 'g')) AS transcript_md5 FROM s GROUP BY job""")
def merge_segments(spark, sf):
    return d.merge_segments(sql(spark, sf, SEGMENT_SQL)).select("job", "language_code", F.md5("transcript").alias("transcript_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def strip_close_tag(spark, sf):
    """Documents with closing tags put around them lose exactly those."""
    text = F.concat(F.lit("</state>"), "text", F.lit("</ STATE >"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t.strip_close_tag(text)).alias("text_md5"))


ATTACHED_SQL = """SELECT conv_id AS message_id, turn AS pos, role || ' "' || CAST(turn AS STRING) || '"' AS name, text, CASE WHEN turn % 2 = 0 THEN CAST(turn AS INT) END AS pages,
  CASE WHEN turn % 4 = 0 THEN CAST(turn AS INT) END AS extracted_pages, CASE WHEN turn % 3 > 0 THEN turn % 3 = 1 END AS truncated,
  CASE WHEN role = 'system' THEN 'error' END AS status, CASE WHEN role = 'system' THEN 'unreadable' END AS note FROM {conversations}"""


@query(f"""WITH a AS ({ATTACHED_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS i FROM a),
tags AS (SELECT message_id, i, '<document index="' || i || '" name="' || replace(name, '"', '&quot;') || '"' || CASE WHEN pages IS NOT NULL THEN ' pages="' || pages || '"' ELSE '' END
  || CASE WHEN extracted_pages IS NOT NULL THEN ' extracted_pages="' || extracted_pages || '"' ELSE '' END || CASE WHEN truncated IS NOT NULL THEN ' truncated="' || truncated || '"' ELSE '' END
  || CASE WHEN status IS NOT NULL THEN ' status="' || status || '"' ELSE '' END || '>' || chr(10)
  || CASE WHEN status IS NOT NULL THEN note ELSE regexp_replace(regexp_replace({LF}, '{CONTROL}', '', 'g'), '(?i)<(/?\\s*documents?[\\s>])', '&lt;\\1', 'g') END || chr(10) || '</document>' AS tag FROM n)
SELECT message_id, md5('{d.PREAMBLE}' || chr(10) || chr(10) || '<documents>' || chr(10) || string_agg(tag, chr(10) ORDER BY i) || chr(10) || '</documents>') AS block_md5 FROM tags GROUP BY message_id""")
def documents_block(spark, sf):
    return d.documents_block(sql(spark, sf, ATTACHED_SQL)).select("message_id", F.md5("block").alias("block_md5"))
