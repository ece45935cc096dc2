"""Chunking and embedding queries over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions.html import html_text
from ragmill.operators import chunking as c
from ragmill.operators import embedding as m
from ragmill.plans import inputs as i
from ragmill.plans import query
from ragmill.streaming import intake
from ragmill.tables import sql, table


def _docs(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("owner"), "text")


@query()
def page_text(spark, sf):
    pages = table(spark, sf, "pages").withColumn("text", html_text(F.col("html")))
    return pages.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


# Pages built from columns: dropped elements, blocks, inline elements, references, a list and text kept as written.
BUILT_PAGE = (
    "'<!DOCTYPE html><html><head><style>p a</style><script>var a = \"</p>\"</script></head><body><nav>Nav ' || CAST(o_orderkey AS STRING) || '</nav>"
    "<h1>' || o_orderpriority || ' &amp; co</h1><p>one <b>two</b>,  three<br>four &lt;' || o_orderstatus || '&gt;</p><template>no</template><ul><li>a</li>"
    "<li>b' || CAST(o_custkey AS STRING) || '</li></ul><pre>\n keep\n  this </pre><!-- no --><div> </div>end</body></html>'"
)


@query("""SELECT o_orderkey AS page_id, concat_ws(chr(10), 'Nav ' || o_orderkey, o_orderpriority || ' & co', 'one two, three', 'four <' || o_orderstatus || '>', 'a', 'b' || o_custkey, ' keep', '  this', 'end') AS text FROM orders""")
def built_page_text(spark, sf):
    pages = sql(spark, sf, f"SELECT o_orderkey AS page_id, {BUILT_PAGE} AS html FROM {{orders}}")
    return pages.select("page_id", html_text(F.col("html")).alias("text"))


@query("SELECT doc_id AS document_id, 0 AS section, CAST(NULL AS VARCHAR) AS header_path, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body_md5 FROM documents WHERE regexp_matches(text, '\\S')")
def header_sections(spark, sf):
    """The given texts have no headings, so each is one section."""
    return c.header_sections(_docs(spark, sf)).select("document_id", "section", "header_path", F.md5("body").alias("body_md5"))


@query()
def chunk_documents(spark, sf):
    chunks = c.chunk_documents(_docs(spark, sf))
    return chunks.select("document_id", "chunk_index", "header_path", F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("text_md5"))


@query()
def split_by_words(spark, sf):
    """The recursive split alone, with small pieces and spaces only."""
    chunks = c.chunk_documents(_docs(spark, sf), size=80, overlap=20, seps=(" ", ""))
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.length("chunk_text")).alias("longest"), F.sum(F.length("chunk_text")).alias("chars")
    )


# Chunk numbers taken from line numbers: dense from 0 for each order.
LINES = """WITH l AS (SELECT l_orderkey, l_linestatus, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS chunk_index FROM lineitem)
"""


@query(f"{LINES} SELECT l_orderkey AS document_id, chunk_index FROM l WHERE l_orderkey NOT IN (SELECT l_orderkey FROM l GROUP BY l_orderkey HAVING count(*) > 4)")
def reject_over_chunked(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), (F.row_number().over(order) - 1).alias("chunk_index")
    )
    return c.reject_over_chunked(lines, 4)


@query()
def chunk_and_embed(spark, sf):
    """Chunks with vectors; a document that was refused, failed or has no text shows it in a row without a chunk."""
    _, chunks = c.chunk_and_embed(_docs(spark, sf), m.hashing_embedder(32), every=True)
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")
    return chunks.select("document_id", "owner", "chunk_index", F.md5("chunk_text").alias("text_md5"), dims, "outcome", "reason")


@query()
def chunked_documents(spark, sf):
    documents, _ = c.chunk_and_embed(_docs(spark, sf), m.hashing_embedder(32))
    return documents.select("document_id", "owner", "chunk_count", "outcome", "reason")


# Files whose fate their key tells: sections by the key's remainder of 7, kind by that of 5, padding by that of 11.
BODY = "repeat('# h\nb\n', CAST(o_orderkey % 7 AS INT)) || CASE WHEN o_orderkey % 11 = 0 THEN repeat(' ', 60) ELSE '' END"
FILE_COLUMNS = (
    "concat_ws('/', 'u' || CAST(o_custkey % 10 AS STRING), CAST(o_orderkey AS STRING), 'a.' || CASE o_orderkey % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' WHEN 3 THEN 'md' ELSE 'docx' END) AS object_key",
    f"encode(CASE WHEN o_orderkey % 5 = 1 THEN '%PDF-1' || {BODY} ELSE {BODY} END, 'utf-8') AS content",
)
FILES = f"SELECT {', '.join(FILE_COLUMNS)} FROM {{orders}}"
SMALL = {"max_bytes": 50, "max_chars": 33, "max_chunks": 4}
JUDGED = """WITH o AS (SELECT concat_ws('/', 'u' || (o_custkey % 10)::varchar, o_orderkey::varchar, 'a.' || CASE o_orderkey % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' WHEN 3 THEN 'md' ELSE 'docx' END) AS document_id,
    'u' || (o_custkey % 10)::varchar AS owner, o_orderkey % 5 AS kind, o_orderkey % 7 AS n, o_orderkey % 11 = 0 AS padded FROM orders),
  r AS (SELECT *, CASE WHEN padded OR (kind = 1 AND 6 + 6 * n > 50) THEN 'too_large' WHEN kind = 2 THEN 'unsupported' WHEN kind = 4 THEN 'content_mismatch' END AS gate FROM o),
  v AS (SELECT *, CASE WHEN gate IS NOT NULL THEN 'rejected' WHEN kind = 1 OR n = 0 THEN 'failed' WHEN n > 4 THEN 'rejected' ELSE 'ok' END AS outcome,
    CASE WHEN gate IS NOT NULL THEN gate WHEN kind = 1 THEN 'error' WHEN n = 0 THEN 'no_text' WHEN n = 6 THEN 'too_many_chars' WHEN n = 5 THEN 'too_many_chunks' END AS reason FROM r)
"""
OUTCOMES = f"{JUDGED} SELECT document_id, owner, outcome, reason, CASE WHEN outcome = 'ok' OR reason = 'too_many_chunks' THEN n ELSE 0 END AS chunk_count FROM v"


@query(OUTCOMES)
def intake_outcomes(spark, sf):
    """Every file comes out once, with what became of it."""
    cut = c.cut_documents(intake.extract(sql(spark, sf, FILES), SMALL), limit=SMALL["max_chunks"])
    return c.outcomes(cut).select("document_id", "owner", "outcome", "reason", "chunk_count")


@query(f"{JUDGED} SELECT document_id, unnest(range(n))::int AS chunk_index, 'h' AS header_path, 'b' AS chunk_text FROM v WHERE outcome = 'ok'")
def intake_chunks(spark, sf):
    cut = c.cut_documents(intake.extract(sql(spark, sf, FILES), SMALL), limit=SMALL["max_chunks"])
    return cut.filter("chunk_index is not null").select("document_id", "chunk_index", "header_path", "chunk_text")


@query("""SELECT o_orderkey AS document_id, unnest([0, 1, 2, 3])::int AS section, unnest([NULL, o_orderstatus, o_orderstatus || ' > ' || o_orderpriority, 'end']) AS header_path,
  unnest(['before ' || o_orderkey, 'one' || chr(10) || '#no heading', 'two', o_clerk]) AS body FROM orders""".replace("o_clerk", "'c' || o_custkey"))
def headed_sections(spark, sf):
    """Sections of texts that are built from columns: levels open, close and lie empty."""
    text = (
        "'before ' || CAST(o_orderkey AS STRING) || '\n# ' || o_orderstatus || '\none\n#no heading\n## ' || o_orderpriority || '\n\ntwo\n### empty\n# end\nc' "
        "|| CAST(o_custkey AS STRING)"
    )
    docs = sql(spark, sf, f"SELECT o_orderkey AS document_id, {text} AS text FROM {{orders}}")
    return c.header_sections(docs).select("document_id", "section", "header_path", "body")


# Runs of equal words: 16 words of 4 letters fill 79 of 80 characters, the next run begins with the last 4.
@query("""WITH o AS (SELECT o_orderkey AS document_id, 1 + o_orderkey % 200 AS n FROM orders),
  k AS (SELECT *, CASE WHEN n <= 16 THEN 1 ELSE 1 + CAST(ceil((n - 16) / 12.0) AS BIGINT) END AS chunks FROM o),
  p AS (SELECT document_id, n, chunks, unnest(range(chunks)) AS i FROM k)
SELECT document_id, i::int AS chunk_index, least(16, n - 12 * i) AS words FROM p""")
def packed_words(spark, sf):
    """The packing rule on words of one length, where it can be told in closed form."""
    docs = sql(spark, sf, "SELECT o_orderkey AS document_id, trim(repeat('abcd ', CAST(1 + o_orderkey % 200 AS INT))) AS text FROM {orders}")
    chunks = c.chunk_documents(docs, size=80, overlap=20, seps=(" ", ""))
    return chunks.select("document_id", "chunk_index", F.size(F.split("chunk_text", " ")).cast("bigint").alias("words"))


WORDS = """o AS (SELECT o_orderkey AS document_id, 'u' || o_custkey AS owner, 1 + o_orderkey % 200 AS n FROM orders),
  k AS (SELECT *, CASE WHEN n <= 16 THEN 1 ELSE 1 + CAST(ceil((n - 16) / 12.0) AS BIGINT) END AS chunks FROM o)"""


def _word_documents(spark, sf):
    text = "trim(repeat('abcd ', CAST(1 + o_orderkey % 200 AS INT)))"
    return sql(spark, sf, f"SELECT o_orderkey AS document_id, 'u' || CAST(o_custkey AS STRING) AS owner, {text} AS text FROM {{orders}}")


def _measures(texts: list[str]) -> list[list[float]]:
    """Vectors that SQL can tell as well: characters and blanks."""
    return [[len(t), t.count(" ")] for t in texts]


@query(f"""WITH {WORDS}, p AS (SELECT *, unnest(range(chunks)) AS i FROM k WHERE chunks <= 10)
SELECT document_id, owner, i::int AS chunk_index, (5 * least(16, n - 12 * i) - 1)::double AS chars, (least(16, n - 12 * i) - 1)::double AS blanks FROM p""")
def embedded_words(spark, sf):
    """Chunks with the vector that their own text gives, documents of more than ten chunks left out whole."""
    _, chunks = c.chunk_and_embed(_word_documents(spark, sf), _measures, 80, 20, 10)
    vector = F.col("embedding")
    return chunks.select("document_id", "owner", "chunk_index", vector[0].cast("double").alias("chars"), vector[1].cast("double").alias("blanks"))


@query(f"""WITH {WORDS} SELECT document_id, owner, chunks AS chunk_count, CASE WHEN chunks > 10 THEN 'rejected' ELSE 'ok' END AS outcome,
  CASE WHEN chunks > 10 THEN 'too_many_chunks' END AS reason FROM k""")
def word_document_outcomes(spark, sf):
    documents, _ = c.chunk_and_embed(_word_documents(spark, sf), _measures, 80, 20, 10)
    return documents.select("document_id", "owner", "chunk_count", "outcome", "reason")


# Paragraphs of 290 characters: three fill a chunk, and none fits into the overlap. Every fifth is longer than a chunk and falls
# into its own lines of 400 characters, of which two fill a chunk.
@query("""WITH o AS (SELECT o_orderkey AS document_id, 1 + o_orderkey % 9 AS n, o_orderkey % 5 = 0 AS long FROM orders),
  p AS (SELECT *, unnest(range(CAST(ceil(n / CASE WHEN long THEN 2.0 ELSE 3.0 END) AS BIGINT))) AS i FROM o)
SELECT document_id, i::int AS chunk_index, CASE WHEN long THEN md5(rtrim(repeat(repeat('x', 400) || chr(10), least(2, n - 2 * i)), chr(10)))
  ELSE md5(rtrim(repeat(repeat('y', 290) || chr(10) || chr(10), least(3, n - 3 * i)), chr(10))) END AS text_md5 FROM p""")
def packed_paragraphs(spark, sf):
    text = "CASE WHEN o_orderkey % 5 = 0 THEN repeat(repeat('x', 400) || '\n', CAST(1 + o_orderkey % 9 AS INT)) ELSE repeat(repeat('y', 290) || '\n\n', CAST(1 + o_orderkey % 9 AS INT)) END"
    docs = sql(spark, sf, f"SELECT o_orderkey AS document_id, {text} AS text FROM {{orders}}")
    return c.chunk_documents(docs).select("document_id", "chunk_index", F.md5("chunk_text").alias("text_md5"))


@query("SELECT doc_id AS id, 64 AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE (embedding IS NULL OR lang = 'en') AND length(trim(text)) > 0")
def embed_missing(spark, sf):
    """Vectors for the documents that have none; English ones are to be made anew."""
    kept = F.when(F.col("collection") != "en", F.col("embedding")).alias("embedding")
    rows = i.corpus(spark, sf).select("id", "text", kept)
    return m.embed_missing(rows, m.hashing_embedder(64)).select("id", F.size("embedding").alias("dims"))
