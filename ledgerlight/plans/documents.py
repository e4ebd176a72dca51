"""Ingest and chunking over the documents table, each row standing for one uploaded file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import dedup
from ledgerlight.operators import documents as docs
from ledgerlight.plans.registry import query
from ledgerlight.sources import sinks
from ledgerlight.streaming.jobs import scratch

# File name by language: two readable kinds, one table kind and one that is refused.
EXTENSIONS = {"en": ".txt", "de": ".MD", "fr": ".pdf", "es": ".exe"}
EXT_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " END"


def files(t):
    ext = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.col("lang")]
    return t.documents.select(
        F.col("doc_id").alias("document_id"), "source",
        F.concat(F.lit("in/doc.v"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.encode("text", "UTF-8").alias("content"))


def texts(t):
    return t.documents.select(F.col("doc_id").alias("document_id"), "source", "text")


@query("src6_document_scan", """
SELECT doc_id AS document_id, 'in/doc.v' || doc_id || """ + EXT_CASE + """ AS filename, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents
""")
def scan(t):
    return files(t).select("document_id", "filename", F.octet_length("content").cast("bigint").alias("size_bytes"))


@query("src7_admission", f"""
SELECT doc_id AS document_id, CASE
  WHEN lower({EXT_CASE}) NOT IN ('.pdf', '.txt', '.md', '.csv', '.xlsx', '.docx') THEN 'unsupported file type: ' || lower({EXT_CASE})
  WHEN octet_length(encode(text)) > 20000 THEN 'file too large'
  WHEN lang IN ('en', 'de') AND trim(text, E' \\n\\t\\r') = '' THEN 'no text content'
  END AS reason FROM documents
""")
def admission(t):
    judged = files(t).withColumn("text", F.decode("content", "UTF-8"))
    return judged.select("document_id", docs.admission_reason(text="text", max_bytes=20000).alias("reason"))


@query("src8_decode_text", """
SELECT doc_id AS document_id, text FROM documents WHERE lang IN ('en', 'de')
""")
def decoded(t):
    plain = files(t).where(docs.suffix("filename").isin(".txt", ".md"))
    return docs.decode_text(plain).select("document_id", "text")


@query("src9_csv_to_markdown", r"""
SELECT conv_id, E'| turn | role | text |\n|---|---|---|\n' || string_agg('| ' || turn || ' | ' || role || ' | ' || text || ' |', E'\n' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def markdown(t):
    return docs.csv_to_markdown(t.conversations, "conv_id", "turn", ["turn", "role", "text"])


@query("src9_csv_file_to_markdown", r"""
SELECT conv_id, E'| turn | text |\n|---|---|\n' || string_agg('| ' || turn || ' | ' || text || ' |', E'\n' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def markdown_of_files(t):
    """Conversations as the bytes of CSV files, their texts quoted, and decoded like any other file."""
    line = F.concat(F.col("turn").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"])
    files_ = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("turn,text\r\n"), F.array_join(rows, "\r\n")).alias("csv"))
    return docs.decode_text(files_.select("conv_id", F.lit("talk.csv").alias("filename"), F.encode("csv", "UTF-8").alias("content"))) \
        .select("conv_id", "text")


@query("doc1_records", f"""
SELECT doc_id AS document_id, 'doc.v' || doc_id AS title, sha256(text) AS content_hash,
  CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
  CASE lang WHEN 'en' THEN 'text/plain' WHEN 'de' THEN 'text/markdown' WHEN 'fr' THEN 'application/pdf' END AS mime_type
FROM documents
""")
def records(t):
    out = docs.document_records(files(t))
    return out.select("document_id", "title", "content_hash", F.col("size_bytes").cast("bigint").alias("size_bytes"), "mime_type")


LETTERS = "etaoinshr"
FIXED_SQL = """
WITH win AS (
  SELECT doc_id, source, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1
    ELSE CAST(ceil((length(text) - 200) / 800.0) AS BIGINT) END)) AS i FROM documents),
chunks AS (SELECT doc_id AS document_id, source, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM win)
"""


@query("doc2_fixed_chunks", FIXED_SQL + """
SELECT document_id, chunk_index, content FROM chunks
""")
def fixed(t):
    return docs.chunk_fixed(texts(t)).select("document_id", "chunk_index", "content")


# One row per state of a text: its pieces' ends at one level of separators, and the piece the next chunk starts with. A
# piece that is too long becomes a state of its own at the next level; keys sort as the text runs.
RECURSIVE_SQL = r"""
WITH RECURSIVE walk(doc_id, key, level, text, b, s, piece) AS (
  SELECT doc_id, '', 1, text, CAST(NULL AS BIGINT[]), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, t.key, t.level, t.text, t.b, t.s, t.piece FROM (
    SELECT doc_id, unnest(CASE
      WHEN b IS NULL THEN [{'key': key, 'level': level, 'text': text, 'b': cuts, 's': CAST(0 AS BIGINT), 'piece': CAST(NULL AS VARCHAR)}]
      WHEN b[s + 2] - b[s + 1] >= 1000 THEN [
        {'key': key || '.' || lpad(CAST(s AS VARCHAR), 7, '0'), 'level': level + 1, 'text': substring(text, b[s + 1] + 1, b[s + 2] - b[s + 1]),
         'b': CAST(NULL AS BIGINT[]), 's': CAST(0 AS BIGINT), 'piece': CAST(NULL AS VARCHAR)},
        {'key': key, 'level': level, 'text': text, 'b': b, 's': s + 1, 'piece': CAST(NULL AS VARCHAR)}]
      ELSE [
        {'key': key || '.' || lpad(CAST(s AS VARCHAR), 7, '0'), 'level': level, 'text': CAST(NULL AS VARCHAR), 'b': [CAST(0 AS BIGINT)],
         's': CAST(0 AS BIGINT), 'piece': substring(text, b[s + 1] + 1, b[e + 1] - b[s + 1])},
        {'key': key, 'level': level, 'text': text, 'b': b, 's': CASE WHEN e = len(b) - 1 OR b[e + 2] - b[e + 1] >= 1000 THEN e
           ELSE list_filter(range(s + 1, e + 1), lambda k: b[e + 1] - b[k + 1] <= 200 AND (b[e + 1] = b[k + 1] OR b[e + 2] - b[k + 1] <= 1000))[1] END,
         'piece': CAST(NULL AS VARCHAR)}] END) AS t
    FROM (SELECT *, coalesce(list_filter(range(s + 1, len(b) - 1), lambda j: b[j + 2] - b[j + 1] >= 1000 OR b[j + 2] - b[s + 1] > 1000)[1], len(b) - 1) AS e,
            CASE WHEN b IS NULL THEN [0] || list_transform(range(1, len(lens) + 1), lambda i: CAST(list_sum(lens[1:i]) AS BIGINT)) END AS cuts
          FROM (SELECT *, CASE WHEN b IS NULL THEN list_filter(list_transform(string_split(text, [E'

', E'
', '. ', ' ', ''][level]),
                  lambda p, i: CAST(len(p) + CASE WHEN i > 1 THEN len([E'

', E'
', '. ', ' ', ''][level]) ELSE 0 END AS BIGINT)), lambda n: n > 0) END AS lens
                FROM walk WHERE b IS NULL OR s < len(b) - 1)))),
parts AS (SELECT doc_id AS document_id, key, trim(piece, E' 
	
') AS content FROM walk WHERE piece IS NOT NULL),
chunks AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY key) - 1 AS INTEGER) AS chunk_index,
  CAST(COUNT(*) OVER (PARTITION BY document_id) AS INTEGER) AS chunk_count, content FROM parts WHERE content <> '')
"""


@query("doc3_recursive_chunks", RECURSIVE_SQL + """
SELECT document_id, chunk_index, chunk_count, content FROM chunks
""")
def recursive(t):
    return docs.chunk_recursive(texts(t)).select("document_id", "chunk_index", "chunk_count", "content")


@query("doc3_recursive_rules", r"""
SELECT doc_id AS document_id, true AS within_size, true AS numbered, true AS from_text, true AS whole
FROM documents WHERE regexp_matches(text, '\S')
""")
def recursive_rules(t):
    """What holds for chunks however a text is cut: size, numbering, and that they are its passages from head to end."""
    cut = docs.chunk_recursive(texts(t)).join(t.documents.select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    body, last = F.regexp_replace("text", r"^\s+|\s+$", ""), F.col("chunk_index") == F.col("chunk_count") - 1
    return cut.groupBy("document_id").agg(
        F.bool_and(F.char_length("content") <= docs.CHUNK_SIZE).alias("within_size"),
        (F.count_distinct("chunk_index") == F.max("chunk_count")).alias("numbered"),
        F.bool_and(F.contains("text", F.col("content"))).alias("from_text"),
        (F.bool_and(F.when(F.col("chunk_index") == 0, F.startswith(body, F.col("content"))))
         & F.bool_and(F.when(last, F.endswith(body, F.col("content"))))).alias("whole"))


@query("doc4_chunk_metadata", FIXED_SQL + f"""
SELECT document_id, chunk_index, CAST(COUNT(*) OVER (PARTITION BY document_id) AS INTEGER) AS chunk_count,
  'doc.v' || document_id AS document_title, 'in/doc.v' || document_id || {EXT_CASE} AS filename, 5 AS n_keys
FROM chunks JOIN documents ON doc_id = document_id
""".replace("lang", "documents.lang"))
def metadata(t):
    made = docs.document_records(files(t)).withColumn("text", F.decode("content", "UTF-8"))
    chunks = docs.chunk_fixed(made)
    return chunks.select("document_id", "chunk_index", "chunk_count",
                         F.try_element_at("metadata", F.lit("document_title")).alias("document_title"),
                         F.try_element_at("metadata", F.lit("filename")).alias("filename"),
                         F.size("metadata").alias("n_keys"))


@query("doc5_chunk_report", FIXED_SQL + """
, per AS (SELECT c.document_id, COUNT(*) AS n, SUM(length(content)) AS chars, any_value(length(d.text)) AS n_chars
  FROM chunks c JOIN documents d ON d.doc_id = c.document_id GROUP BY c.document_id)
SELECT 'fixed' AS strategy, CAST(SUM(n) AS BIGINT) AS chunk_count, ROUND(SUM(chars) / SUM(n), 4) AS avg_chunk_size,
  ROUND(SUM(greatest(chars - n_chars, 0)) / SUM(chars), 6) AS overlap_ratio FROM per
""")
def report(t):
    base = texts(t)
    chars = base.select("document_id", F.char_length("text").alias("n_chars"))
    stats = docs.chunk_stats(docs.chunk_fixed(base), chars, "fixed")
    return stats.withColumn("avg_chunk_size", F.round("avg_chunk_size", 4)).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@query("doc5_recursive_chunk_report", RECURSIVE_SQL + """
, per AS (SELECT c.document_id, COUNT(*) AS n, SUM(length(content)) AS chars, any_value(length(d.text)) AS n_chars
  FROM chunks c JOIN documents d ON d.doc_id = c.document_id GROUP BY c.document_id)
SELECT 'recursive' AS strategy, CAST(SUM(n) AS BIGINT) AS chunk_count, ROUND(SUM(chars) / SUM(n), 4) AS avg_chunk_size,
  ROUND(SUM(greatest(chars - n_chars, 0)) / SUM(chars), 6) AS overlap_ratio FROM per
""")
def recursive_report(t):
    base = texts(t)
    chars = base.select("document_id", F.char_length("text").alias("n_chars"))
    stats = docs.chunk_stats(docs.chunk_recursive(base), chars, "recursive")
    return stats.withColumn("avg_chunk_size", F.round("avg_chunk_size", 4)).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@query("doc6_embed_chunks", FIXED_SQL + """
SELECT document_id, chunk_index, [""" + ", ".join(
    f"CAST(length(content) - length(replace(content, '{c}', '')) AS DOUBLE)" for c in LETTERS) + """] AS embedding FROM chunks
""")
def embedded_by_provider(t):
    """Vectors of a provider, here one that counts letters."""
    def letters(text):
        return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])

    return docs.embed(docs.chunk_fixed(texts(t)), letters).select("document_id", "chunk_index", "embedding")


@query("doc6_hashed_terms", FIXED_SQL + """
SELECT document_id, chunk_index, 256 AS width, 1.0 AS length FROM chunks
""")
def embedded(t):
    vectors = docs.embed(docs.chunk_fixed(texts(t)))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("document_id", "chunk_index", F.size("embedding").alias("width"), F.round(length, 4).alias("length"))


@query("doc7_embedding_profile", """
SELECT vec_id, CAST(384 AS INTEGER) AS expected_dim, CAST(256 AS INTEGER) AS max_tokens,
  CAST(len(embedding) AS INTEGER) AS actual_dim, len(embedding) = 384 AS dimension_ok FROM embeddings
""")
def profile(t):
    return docs.check_dimension(t.embeddings, "all-MiniLM-L6-v2").drop("embedding", "label")


@query("doc8_ingest", FIXED_SQL + f"""
SELECT document_id, CAST(COUNT(*) AS BIGINT) AS stored_chunks, MAX(CAST(length(content) AS INTEGER)) AS longest_chunk,
  256 AS width, CAST(NULL AS VARCHAR) AS reason FROM chunks JOIN documents ON doc_id = document_id
WHERE documents.lang IN ('en', 'de') AND doc_id % 10 <> 3 AND trim(documents.text, E' \\n\\t\\r') <> '' GROUP BY document_id
UNION ALL
SELECT doc_id, 0, NULL, NULL, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported file type: ' || lower({EXT_CASE})
  WHEN lang = 'fr' THEN 'no extractor for .pdf' WHEN doc_id % 10 = 3 THEN 'not valid UTF-8' ELSE 'no text content' END
FROM documents WHERE lang NOT IN ('en', 'de') OR doc_id % 10 = 3 OR trim(text, E' \\n\\t\\r') = ''
""")
def ingested(t):
    """Files to stored chunks, read back, and the files turned away; every tenth file is broken in its bytes."""
    broken = files(t).withColumn("content", F.when(F.col("document_id") % 10 == 3, F.concat("content", F.unhex(F.lit("FF"))))
                                 .otherwise(F.col("content")))
    chunks, rejected = docs.ingest(broken, strategy="fixed")
    path = scratch(t.spark, "chunks")
    sinks.write_chunks(chunks.select("document_id", "chunk_id", "source", "content", "embedding"), path)
    stored = t.spark.read.parquet(path).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("stored_chunks"), F.max(F.char_length("content")).alias("longest_chunk"),
        F.min(F.size("embedding")).alias("width"))
    none = F.lit(None).cast("int")
    return stored.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected.select(
        "document_id", F.lit(0).cast("long").alias("stored_chunks"), none.alias("longest_chunk"), none.alias("width"), "reason"))


@query("src12_drop_documents", FIXED_SQL + """
SELECT document_id, COUNT(*) AS chunk_count FROM chunks
WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id
""")
def dropped(t):
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return docs.collection_stats(docs.drop_documents(docs.chunk_fixed(texts(t)), toxic))


@query("src13_collection_stats", FIXED_SQL + """
SELECT document_id, COUNT(*) AS chunk_count FROM chunks GROUP BY document_id
""")
def stats(t):
    return docs.collection_stats(docs.chunk_fixed(texts(t)))


@query("jn9_cascade_removal", """
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
""")
def cascade(t):
    removed = t.conversations.where("role = 'system'").select("conv_id")
    return docs.drop_documents(t.conversations.select("conv_id", "turn"), removed, "conv_id")


COPIES_SQL = r"""
w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
s AS (SELECT MIN(doc_id) AS id, list_sort(w) AS w, len(any_value(w)) AS n FROM w WHERE len(w) > 0 GROUP BY list_sort(w)),
c AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n2, len(list_intersect(a.w, b.w)) AS k
  FROM s a JOIN s b ON a.id < b.id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 1e-9),
e AS (SELECT a, b FROM c WHERE k / (n2 - k) >= 0.9 - 1e-9)
"""


GROUPS_SQL = "WITH RECURSIVE " + COPIES_SQL + r"""
, links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id AS root, id FROM s UNION SELECT r.root, b.b FROM reach r JOIN links b ON b.a = r.id),
g AS (SELECT id, MIN(root) AS group_id FROM reach GROUP BY id),
own AS (SELECT d.doc_id, g.group_id FROM w d JOIN s ON s.w = list_sort(d.w) JOIN g ON g.id = s.id WHERE len(d.w) > 0)
"""


@query("jn10_near_copies", GROUPS_SQL + """
SELECT d.doc_id, coalesce(o.group_id, d.doc_id) AS group_id,
  CASE WHEN len(d.w) > 0 THEN round(len(list_intersect(d.w, b.w)) / (len(d.w) + len(b.w) - len(list_intersect(d.w, b.w))), 6) END AS similarity
FROM w d LEFT JOIN own o USING (doc_id) JOIN w b ON b.doc_id = coalesce(o.group_id, d.doc_id)
""")
def near(t):
    return dedup.near_copies(t.documents, "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


@query("dd2_corpus_groups", GROUPS_SQL + """
SELECT d.doc_id, coalesce(o.group_id, d.doc_id) AS group_id FROM documents d LEFT JOIN own o USING (doc_id)
""")
def copies(t):
    return dedup.dedup_corpus(t.documents, "doc_id", "text")
