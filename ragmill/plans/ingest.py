"""Source, sink and intake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions import dates, files
from ragmill.operators import chunking as c
from ragmill.plans import inputs as i
from ragmill.plans import query
from ragmill.session import shared_dir
from ragmill.sources import bronze, jsonl, lawxml, snapshots
from ragmill.tables import sql, table

# A law XML per document: two articles, a deleted one, a stub, a supplement and an
# amending supplement; Spanish documents are cut off and cannot be parsed.
def _escaped(col):
    return F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _law_files(spark, sf):
    docs = table(spark, sf, "documents")
    body = _escaped(F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x1F\x7F￾￿]+", " "), WIDE, " ")))
    xml = F.concat(
        F.lit('<Law Era="Reiwa" Year="2" LawType="Act" PromulgateMonth="4"><LawNum>N'), F.col("doc_id").cast("string"),
        F.lit("</LawNum><LawBody><LawTitle>Act of "), F.col("source"), F.lit("</LawTitle><MainProvision><Article Num=\"1\"><ArticleCaption>("),
        F.col("lang"), F.lit(")</ArticleCaption><ArticleTitle>T1</ArticleTitle><Paragraph><ParagraphNum/><ParagraphSentence><Sentence>"),
        body, F.lit("</Sentence></ParagraphSentence><Item><ItemTitle>i</ItemTitle><ItemSentence>one</ItemSentence></Item></Paragraph></Article>"
        '<Article Num="2" Delete="true"><ArticleTitle>T2</ArticleTitle></Article>'
        '<Article Num="3"><ArticleTitle>T3</ArticleTitle><Paragraph><ParagraphSentence>削除</ParagraphSentence></Paragraph></Article>'
        '</MainProvision><SupplProvision><Article Num="1"><ArticleTitle>S1</ArticleTitle><Paragraph><ParagraphSentence>in force</ParagraphSentence></Paragraph></Article></SupplProvision>'
        '<SupplProvision AmendLawNum="x"><Article Num="1"><ArticleTitle>A1</ArticleTitle></Article></SupplProvision></LawBody></Law>'),
    )
    whole = F.when(F.col("lang") == "es", F.substring_index(xml, "<MainProvision>", 1)).otherwise(xml)
    path = F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit("_20200401_1.xml"))
    return docs.select(path.alias("path"), F.encode(whole, "utf-8").alias("content"))


#: Whitespace that Python strips and a regex class does not always cover.
WIDE = "[\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
ARTICLE_BODY = (
    "trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F\uFFFE\uFFFF]+', ' ', 'g'), "
    "'[\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+', ' ', 'g'), ' ')"
)


@query(f"""WITH d AS (SELECT *, {ARTICLE_BODY} AS body FROM documents WHERE lang <> 'es')
SELECT doc_id || '_20200401_1' AS law_id, 'N' || doc_id AS law_num, 'Act of ' || source AS law_title, 'Main_Article_1' AS unique_anchor, 'Mp-At_1' AS anchor,
  md5('(' || lang || ')　T1' || chr(10) || '　　' || body || chr(10) || '　　i　one') AS content_md5, '(' || lang || ')' AS article_summary,
  'Reiwa' AS era, 2 AS year, 'Act' AS law_type, '2020-04-01' AS promulgate_date FROM d
UNION ALL SELECT doc_id || '_20200401_1', 'N' || doc_id, 'Act of ' || source, 'Suppl_Article_1', NULL, md5('S1' || chr(10) || '　in force'), 'in force',
  'Reiwa', 2, 'Act', '2020-04-01' FROM d""")
def law_xml_articles(spark, sf):
    rows = lawxml.articles(lawxml.parse_law_xml(_law_files(spark, sf)))
    return rows.withColumn("content_md5", F.md5("content")).drop("content")


@query("SELECT '/corpus/' || doc_id || '_20200401_1.xml' AS path FROM documents WHERE lang = 'es'")
def law_xml_errors(spark, sf):
    return lawxml.errors(lawxml.parse_law_xml(_law_files(spark, sf))).select("path")


ERA_SQL = """SELECT event_id, CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'Meiji' WHEN 1 THEN 'Taisho' WHEN 2 THEN 'Showa' WHEN 3 THEN 'Heisei'
  WHEN 4 THEN 'Reiwa' WHEN 5 THEN 'Other' END AS era,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'x' ELSE CAST(user_id AS STRING) END AS y,
  CASE WHEN event_type = 'click' THEN NULL ELSE CAST(user_id % 12 + 1 AS STRING) END AS m,
  CASE WHEN event_type = 'signup' THEN '' ELSE CAST(user_id % 28 + 1 AS STRING) END AS d FROM {events}"""


@query(f"""WITH e AS ({ERA_SQL}) SELECT event_id, printf('%04d-%02d-%02d',
  coalesce(CASE era WHEN 'Meiji' THEN 1867 WHEN 'Taisho' THEN 1911 WHEN 'Showa' THEN 1925 WHEN 'Heisei' THEN 1988 WHEN 'Reiwa' THEN 2018 END, 0)
    + coalesce(try_cast(y AS INTEGER), 0), coalesce(try_cast(m AS INTEGER), 1), coalesce(try_cast(d AS INTEGER), 1)) AS day FROM e""")
def era_to_date(spark, sf):
    day = dates.era_to_date(F.col("era"), F.col("y"), F.col("m"), F.col("d"))
    return sql(spark, sf, ERA_SQL).select("event_id", day.alias("day"))


# Interchange lines: raw text fields, some empty, some null.
LINES_SQL = f"""SELECT law_id, law_num, law_title, unique_anchor, anchor, content,
  CASE WHEN law_type = 'F' THEN '' ELSE article_summary END AS article_summary, CASE WHEN law_type = 'O' THEN '' ELSE era END AS era,
  CASE WHEN law_type = 'F' THEN '' ELSE CAST(year AS STRING) END AS year, law_type,
  CASE WHEN promulgate_date IS NULL THEN '' ELSE CAST(promulgate_date AS STRING) END AS promulgate_date FROM ({i.DWH_SQL}) dwh"""
STAGED = """law_id, law_num, law_title, unique_anchor, nullif(anchor, '') AS anchor, content, nullif(article_summary, '') AS article_summary,
  nullif(era, '') AS era, CAST(nullif(year, '') AS INTEGER) AS year, nullif(law_type, '') AS law_type, CAST(nullif(promulgate_date, '') AS DATE) AS promulgate_date"""


@query(f"WITH l AS ({LINES_SQL}) SELECT {STAGED} FROM l")
def jsonl_round_trip(spark, sf):
    """Write interchange lines, read them back, type them."""
    path = shared_dir(spark) + "/jsonl"
    jsonl.write_jsonl(sql(spark, sf, LINES_SQL), path)
    return jsonl.coerce_staging(jsonl.read_jsonl(spark, path))


@query(f"WITH l AS ({LINES_SQL}) SELECT {STAGED} FROM l")
def coerce_staging(spark, sf):
    return jsonl.coerce_staging(sql(spark, sf, LINES_SQL))


@query(f"""WITH l AS ({LINES_SQL}) SELECT CAST(count_if(law_type <> 'P') AS BIGINT) AS total, count(DISTINCT CASE WHEN law_type <> 'P' THEN law_id END) AS laws,
  CAST(count_if(law_type <> 'P' AND length(anchor) > 0) AS BIGINT) AS anchored, CAST(count_if(law_type = 'P') AS BIGINT) AS malformed,
  min(CASE WHEN law_type <> 'P' THEN law_id END) AS sample_law_id FROM l""")
def profile_jsonl(spark, sf):
    """Lines of law type P are broken on purpose; every third line is blank space."""
    rows = sql(spark, sf, LINES_SQL)
    line = F.to_json(F.struct(*jsonl.NAMES))
    broken = F.when(F.col("law_type") == "P", F.concat(F.lit("{"), line)).otherwise(line)
    lines = rows.select(F.explode(F.array(broken, F.lit("  "))).alias("value"))
    return jsonl.profile_lines(jsonl.parse_lines(lines))


def _page_files(spark, sf):
    pages = table(spark, sf, "pages")
    key = F.concat_ws("/", F.split_part("url", F.lit("/"), F.lit(4)), F.col("page_id").cast("string"), F.lit("page.html"))
    return pages.select(key.alias("object_key"), F.encode("html", "utf-8").alias("content"))


@query("""SELECT split_part(url, '/', 4) AS owner, split_part(url, '/', 4) || '/' || page_id || '/page.html' AS object_key, 'page.html' AS filename,
  CAST(strlen(html) AS INTEGER) AS byte_size, sha256(html) AS sha256 FROM pages""")
def bronze_files(spark, sf):
    return bronze.describe(_page_files(spark, sf)).drop("content")


UPLOADS_SQL = """SELECT CAST(user_id AS STRING) AS owner, CAST(user_id AS STRING) || '/' || event_type || '/f' AS object_key, event_id AS arrived FROM {events}"""


@query(f"""WITH u AS ({UPLOADS_SQL}) SELECT owner, object_key, min(arrived) AS arrived FROM u
WHERE object_key NOT IN (SELECT o_custkey || '/view/f' FROM orders) GROUP BY owner, object_key""")
def reject_duplicate_bronze(spark, sf):
    owner = F.col("o_custkey").cast("string")
    existing = table(spark, sf, "orders").select(owner.alias("owner"), F.concat(owner, F.lit("/view/f")).alias("object_key"))
    return bronze.reject_duplicate_bronze(sql(spark, sf, UPLOADS_SQL), existing)


@query("""SELECT source AS owner, doc_id AS document_id, 0 AS chunk_index, md5(text) AS text_md5, len(embedding) AS dims,
  '{"max_size":1000,"overlap":120}' AS chunker_config, 'hashing' AS embedding_model
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def write_chunks(spark, sf):
    """Append chunks to a bucket-foldered table and read it back."""
    chunks = i.corpus(spark, sf).select(
        "owner", F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), "embedding"
    )
    root = shared_dir(spark) + "/chunks"
    snapshots.write_chunks(chunks, root, "hashing", {"max_size": 1000, "overlap": 120})
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint")
    return snapshots.read_chunks(spark, root).select(
        "owner", "document_id", "chunk_index", F.md5("chunk_text").alias("text_md5"), dims.alias("dims"),
        "chunker_config", "embedding_model",
    )


@query(f"WITH {i.INDEX_SQL} SELECT law_num, unique_anchor, law_id, is_future FROM idx")
def write_snapshot(spark, sf):
    """Two rebuilds into one snapshot table; readers see the second."""
    from ragmill.operators import warehouse as w

    root = shared_dir(spark) + "/index"
    old = w.version_index(i.dwh(spark, sf), "1996-01-01").select("law_num", "unique_anchor", "law_id", "is_future")
    snapshots.write_snapshot(old, root)
    new = w.version_index(i.dwh(spark, sf), i.TODAY).select("law_num", "unique_anchor", "law_id", "is_future")
    snapshots.write_snapshot(new, root)
    return snapshots.read_snapshot(spark, root)


NAMED_SQL = """SELECT page_id, CASE CAST(page_id % 9 AS INT) WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'c.md' WHEN 3 THEN 'noext' WHEN 4 THEN 'd.html'
  WHEN 5 THEN 'e.png' WHEN 6 THEN 'f.csv' WHEN 7 THEN 'g.' ELSE 'h.tar.xlsx' END AS name,
  CASE CAST(page_id % 4 AS INT) WHEN 0 THEN ' Text/HTML ; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/octet-stream' ELSE 'text/plain' END AS media,
  length(html) AS char_count FROM {pages}"""
KIND_SQL = f"""kinds AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(list_last(string_split(name, '.'))) ELSE '' END AS ext,
  lower(trim(split_part(media, ';', 1))) AS m FROM ({NAMED_SQL})),
kinded AS (SELECT *, CASE WHEN ext = 'pdf' OR m = 'application/pdf' THEN 'pdf' WHEN ext = 'docx' THEN 'docx' WHEN ext = 'xlsx' THEN 'xlsx'
  WHEN ext IN ('html', 'htm') OR m IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN m LIKE 'image/%' THEN 'image'
  WHEN ext IN ('txt', 'md', 'markdown', 'csv') OR m IN ('text/plain', 'text/markdown') THEN 'text' ELSE 'unsupported' END AS kind FROM kinds)"""


@query(f"WITH {KIND_SQL} SELECT page_id, kind FROM kinded")
def detect_kind(spark, sf):
    named = sql(spark, sf, NAMED_SQL)
    return named.select("page_id", files.detect_kind(F.col("name"), F.col("media")).alias("kind"))


def _with_magic(spark, sf):
    magic = F.array(*[F.lit(bytes.fromhex(h)) for h in (*files.MAGIC, "3C")])
    pages = table(spark, sf, "pages")
    head = F.element_at(magic, (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    return pages.select("page_id", F.concat(head, F.encode("html", "utf-8")).alias("content"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 6 THEN 'unknown' ELSE 'image' END AS container FROM pages""")
def sniff_container(spark, sf):
    return _with_magic(spark, sf).select("page_id", files.sniff_container(F.col("content")).alias("container"))


GATE_SQL = f"""SELECT page_id, name AS filename, media AS media_type, char_count * 10 AS byte_size,
  CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' ELSE 'unknown' END AS container,
  CASE CAST(page_id % 11 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'no_text' WHEN 2 THEN 'too_large' END AS status,
  CAST(page_id % 400 AS INT) AS pages, char_count FROM ({NAMED_SQL}) n"""


@query(f"""WITH {KIND_SQL}, g AS ({GATE_SQL}), j AS (SELECT g.*, k.kind, k.ext FROM g JOIN kinded k ON k.page_id = g.page_id),
r AS (SELECT *, CASE WHEN byte_size > 60000 THEN 'too_large' WHEN kind IN ('image', 'unsupported') THEN 'unsupported'
  WHEN container <> CASE WHEN kind = 'pdf' THEN 'pdf' WHEN kind IN ('docx', 'xlsx') THEN 'zip' ELSE 'unknown' END THEN 'content_mismatch'
  WHEN status = 'timeout' THEN 'timeout' WHEN status = 'too_large' THEN 'too_large' END AS early,
  CASE WHEN pages > 100 THEN 'too_many_pages' WHEN char_count > 4000 THEN 'too_many_chars' END AS late FROM j)
SELECT page_id, CASE WHEN early IS NULL AND status IS NOT NULL THEN 'failed' WHEN early IS NOT NULL OR late IS NOT NULL THEN 'rejected' ELSE 'ok' END AS outcome,
  CASE WHEN early IS NULL AND status IS NOT NULL THEN status ELSE coalesce(early, late) END AS reason FROM r""")
def gate_documents(spark, sf):
    out = c.gate_documents(sql(spark, sf, GATE_SQL), {"max_bytes": 60000, "max_pages": 100, "max_chars": 4000})
    return out.select("page_id", "outcome", "reason")


@query("SELECT page_id, md5(html) AS text_md5 FROM pages")
def decode_text(spark, sf):
    """Pages stored as UTF-8, with a mark, as UTF-16 with a mark, come back the same."""
    pages = table(spark, sf, "pages")
    way = F.pmod("page_id", F.lit(3))
    stored = (
        F.when(way == 0, F.encode("html", "utf-8"))
        .when(way == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("html", "utf-8")))
        .otherwise(F.concat(F.lit(b"\xff\xfe"), F.encode("html", "utf-16le")))
    )
    return pages.select("page_id", F.md5(files.decode_text(stored)).alias("text_md5"))


CELLS_SQL = """SELECT event_id, CASE event_type WHEN 'view' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 'click' THEN TIMESTAMP '1899-12-30 00:00:00' + (ts - CAST(CAST(ts AS DATE) AS TIMESTAMP))
  WHEN 'error' THEN date_trunc('minute', ts) ELSE ts END AS cell FROM {events}"""


@query(f"""WITH c AS (SELECT event_id, make_timestamp(CAST(floor(epoch_us(CAST(cell AS TIMESTAMP)) / 1000000.0::DOUBLE + 0.5) AS BIGINT) * 1000000) AS t FROM ({CELLS_SQL}))
SELECT event_id, CASE WHEN strftime(t, '%H:%M:%S') = '00:00:00' THEN strftime(t, '%Y-%m-%d')
  WHEN CAST(t AS DATE) IN (DATE '1899-12-30', DATE '1904-01-01') THEN CASE WHEN second(t) = 0 THEN strftime(t, '%H:%M') ELSE strftime(t, '%H:%M:%S') END
  WHEN second(t) = 0 THEN strftime(t, '%Y-%m-%d %H:%M') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS label FROM c""")
def format_date_cell(spark, sf):
    return sql(spark, sf, CELLS_SQL).select("event_id", dates.format_date_cell(F.col("cell")).alias("label"))


EXTRACTED_SQL = """SELECT doc_id, CASE lang WHEN 'en' THEN 'node-html-parser' WHEN 'fr' THEN 'text-decode' ELSE 'mammoth' END AS extractor,
  CASE WHEN quality = 1 THEN '9.0.4+r2' WHEN quality = 0 THEN '1+r1' END AS extractor_version, lang AS mime, n_chars AS char_count,
  n_chars % 7 AS chunk_count, n_chars % 11 AS extract_ms, n_chars % 13 AS embed_ms
FROM {documents} d LEFT JOIN {labels} l USING (doc_id)"""


@query(f"""WITH d AS ({EXTRACTED_SQL}) SELECT doc_id FROM d WHERE NOT coalesce((extractor = 'node-html-parser' AND extractor_version = '9.0.4+r2')
  OR (extractor = 'text-decode' AND extractor_version = '1+r1') OR (extractor = 'mammoth' AND extractor_version = '1.12.3+r1'), FALSE)""")
def stale_documents(spark, sf):
    return c.stale_documents(sql(spark, sf, EXTRACTED_SQL)).select("doc_id")


@query(f"WITH {KIND_SQL} SELECT page_id, CASE kind WHEN 'pdf' THEN '6.3.289+r1' WHEN 'docx' THEN '1.12.3+r1' WHEN 'xlsx' THEN '9.3.10+r1' WHEN 'html' THEN '9.0.4+r2' WHEN 'text' THEN '1+r1' END AS label FROM kinded")
def extractor_label(spark, sf):
    kind = files.detect_kind(F.col("name"), F.col("media"))
    return sql(spark, sf, NAMED_SQL).select("page_id", files.current_label(kind).alias("label"))


@query(f"""WITH d AS ({EXTRACTED_SQL}) SELECT mime, count(*) AS documents, CAST(sum(char_count) AS BIGINT) AS chars, CAST(sum(chunk_count) AS BIGINT) AS chunks,
  CAST(sum(extract_ms) AS BIGINT) AS extract_ms, CAST(sum(embed_ms) AS BIGINT) AS embed_ms FROM d GROUP BY mime""")
def ingest_report(spark, sf):
    return c.ingest_report(sql(spark, sf, EXTRACTED_SQL))
