"""Vector search over the embeddings table and over document chunks.

Questions for the embeddings are the mean vectors of the labels: derived from the whole table,
a few rows however many vectors there are. The document with a vector's number is its chunk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import text as tx
from ledgerlight.functions.vectors import cosine, mean_vectors
from ledgerlight.operators import cells
from ledgerlight.operators import documents as docs
from ledgerlight.operators import retrieval as ret
from ledgerlight.plans.documents import FIXED_SQL, LETTERS
from ledgerlight.plans.registry import query
from ledgerlight.session import cut_lineage
from ledgerlight.streaming.jobs import scratch

QUERY_SQL = """
WITH parts AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, AVG(CAST(v AS DOUBLE)) AS m FROM parts GROUP BY label, i),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM means GROUP BY label),
"""
SCORED_SQL = QUERY_SQL + """
scored AS (SELECT q.query_id, e.vec_id AS chunk_id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings e),
hits AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= 20)
"""


def label_queries(t):
    return mean_vectors(t.embeddings, "label", "embedding", "query_vector").withColumnRenamed("label", "query_id")


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")


def found(t, k=20):
    return ret.knn(label_queries(t), vectors(t), k)


def contents(t):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang",
                              F.when(F.col("lang") != "es", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"))


def hits(t):
    return ret.to_hits(found(t).join(contents(t), "chunk_id")).drop("content")


@query("ret1_cosine", QUERY_SQL.rstrip().rstrip(",") + """
SELECT e.vec_id, ROUND(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS score
FROM embeddings e JOIN q ON q.query_id = e.label
""")
def similarity(t):
    means = label_queries(t).withColumnRenamed("query_id", "label")
    return t.embeddings.join(means, "label").select(
        "vec_id", F.round(cosine("embedding", "query_vector"), 6).alias("score"))


RET2_SQL = SCORED_SQL + """
SELECT query_id, chunk_id, rank, ROUND(score, 6) AS score FROM hits
"""


@query("ret2_knn", RET2_SQL)
def nearest(t):
    return found(t).withColumn("score", F.round("score", 6))


@query("ret2_cells_knn", RET2_SQL)
def nearest_by_cells(t):
    """The same search through an index of cells."""
    index = cells.build_cells(vectors(t), scratch(t.spark, "cells"))
    return cells.search_cells(label_queries(t), index).hits.withColumn("score", F.round("score", 6))


JN5_SQL = QUERY_SQL + """
scored AS (SELECT q.query_id, e.vec_id AS chunk_id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS score
  FROM q, embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.source IN ('src1', 'src2', 'src3'))
SELECT query_id, chunk_id, ROUND(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank
FROM scored QUALIFY rank <= 10
"""


@query("jn5_knn_source_filter", JN5_SQL)
def nearest_in_sources(t):
    chunks = vectors(t).join(contents(t).select("chunk_id", "source"), "chunk_id")
    return ret.knn(label_queries(t), chunks, 10, where=F.col("source").isin("src1", "src2", "src3")) \
        .withColumn("score", F.round("score", 6))


@query("jn5_cells_source_filter", JN5_SQL)
def nearest_in_sources_by_cells(t):
    """The filter rules out vectors inside the cells that are read."""
    chunks = vectors(t).join(contents(t).select("chunk_id", "source"), "chunk_id")
    index = cells.build_cells(chunks, scratch(t.spark, "cells"))
    search = cells.search_cells(label_queries(t), index, 10, where=F.col("source").isin("src1", "src2", "src3"))
    return search.hits.withColumn("score", F.round("score", 6))


@query("flt7_metadata_filter", """
SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'
""")
def metadata(t):
    predicate = ret.metadata_filter(
        {"source": ["src1", "src2", "nowhere"], "lang": ["en", "xx"], "owner": "me", "kind": ["a"]},
        {"source": [f"src{i}" for i in range(20)], "lang": ["en", "de", "fr", "es"], "kind": ["b"]},
        {"source": F.col("source"), "lang": F.col("lang")})
    return t.documents.select("doc_id", "source", "lang").where(predicate)


@query("flt8_min_score", SCORED_SQL + """
SELECT query_id, chunk_id, rank, ROUND(score, 6) AS score FROM hits WHERE score >= 0.3
""")
def scored(t):
    return ret.min_score(found(t), 0.3).withColumn("score", F.round("score", 6))


TEXT_HITS_SQL = SCORED_SQL + """
, texts AS (SELECT h.*, coalesce(CASE WHEN lang <> 'es' THEN 'doc ' || doc_id END, 'Unknown') AS title,
  substring(text, 1, 500) AS chunk_content, source FROM hits h JOIN documents d ON d.doc_id = h.chunk_id)
"""


@query("ret3_snippets", TEXT_HITS_SQL + """
SELECT query_id, chunk_id, rank, title, chunk_content FROM texts
""")
def snippets(t):
    return hits(t).select("query_id", "chunk_id", "rank", "title", "chunk_content")


@query("dd1_dedup_hits", TEXT_HITS_SQL.replace("WITH parts", "WITH RECURSIVE parts") + r"""
, worded AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(chunk_content), '\s+'), lambda w: w <> '')) AS w FROM texts),
walk AS (
  SELECT query_id, 0 AS step, CAST([] AS VARCHAR[][]) AS kept, CAST([] AS BIGINT[]) AS ids FROM (SELECT DISTINCT query_id FROM worded)
  UNION ALL
  SELECT k.query_id, k.step + 1,
    CASE WHEN h.chunk_id IS NULL OR len(list_filter(k.kept, lambda s: len(s) > 0 AND len(h.w) > 0 AND
        len(list_intersect(s, h.w)) / (len(s) + len(h.w) - len(list_intersect(s, h.w))) >= 0.9)) > 0 THEN k.kept ELSE list_append(k.kept, h.w) END,
    CASE WHEN h.chunk_id IS NULL OR len(list_filter(k.kept, lambda s: len(s) > 0 AND len(h.w) > 0 AND
        len(list_intersect(s, h.w)) / (len(s) + len(h.w) - len(list_intersect(s, h.w))) >= 0.9)) > 0 THEN k.ids ELSE list_append(k.ids, h.chunk_id) END
  FROM walk k LEFT JOIN worded h ON h.query_id = k.query_id AND h.rank = k.step + 1 WHERE k.step < 20)
SELECT query_id, unnest(ids) AS chunk_id FROM walk WHERE step = 20
""")
def deduplicated(t):
    return ret.dedup_hits(hits(t)).select("query_id", "chunk_id")


QUESTION_SQL = """
SELECT query_id, t.chunk_id, title, %s AS score FROM texts t
"""


@query("ret4_rerank", TEXT_HITS_SQL + r"""
, asked AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(first_text), '\s+'), lambda w: w <> '')) AS qw,
  list_distinct(list_filter(regexp_split_to_array(lower(chunk_content), '\s+'), lambda w: w <> '')) AS cw
  FROM texts JOIN (SELECT item_id, text AS first_text FROM benchmark) b ON b.item_id = query_id),
rated AS (SELECT query_id, chunk_id, rank AS before, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw)) / len(qw) ELSE 0.0 END AS score FROM asked)
SELECT query_id, chunk_id, ROUND(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INTEGER) AS rank FROM rated QUALIFY rank <= 10
""")
def reranked(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    scored_hits = hits(t).join(asked, "query_id")
    out = ret.rerank(scored_hits, ret.overlap_score(), 10)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("ret6_retrieval_stats", SCORED_SQL + """
SELECT query_id, CAST(64 AS INTEGER) AS query_embedding_dim, COUNT(*) AS retrieved_count, false AS reranked,
  ROUND(MAX(score), 6) AS best_score, ROUND(MIN(score) FILTER (WHERE rank <= 5), 6) AS fifth_score
FROM hits GROUP BY query_id
""")
def stats(t):
    out = ret.retrieval_stats(found(t), 64)
    return out.select("query_id", "query_embedding_dim", "retrieved_count", "reranked",
                      F.round(F.get("top_scores", F.lit(0)), 6).alias("best_score"),
                      F.round(F.get("top_scores", F.lit(4)), 6).alias("fifth_score"))


@query("fn6_prefix_cuts", """
SELECT doc_id, substring(text, 1, 500) AS c500, substring(text, 1, 300) AS c300, substring(text, 1, 200) AS c200,
  substring(text, 1, 100) AS c100, substring(text, 1, 50) AS c50 FROM documents
""")
def cuts(t):
    return t.documents.select("doc_id", *[tx.snippet("text", n).alias(f"c{n}") for n in (500, 300, 200, 100, 50)])


def benchmark_queries(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return docs.hashed_terms(asked, "question", "query_vector")


def document_chunks(t):
    base = t.documents.select(F.col("doc_id").alias("document_id"), "source", "text",
                              F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    return docs.embed(docs.chunk_recursive(base)).drop("metadata")


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


@query("ret5_retrieve_fixed", FIXED_SQL.replace("WITH win", "WITH RECURSIVE win") + f"""
, vec AS (SELECT document_id, document_id || '-' || chunk_index AS chunk_id, content, 'doc ' || document_id AS title, {_letters_sql('content')} AS e FROM chunks),
q AS (SELECT item_id AS query_id, text AS question, {_letters_sql('text')} AS qv FROM benchmark),
scored AS (SELECT query_id, question, document_id, chunk_id, title, substring(content, 1, 500) AS chunk_content,
  round(CASE WHEN list_sum(e) > 0 AND list_sum(qv) > 0 THEN list_cosine_similarity(qv, e) ELSE 0 END, 12) AS score FROM q, vec),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 20),
worded AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(chunk_content), '\\s+'), lambda w: w <> '')) AS w,
  list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '')) AS qw FROM top WHERE score >= 0.3),
walk AS (
  SELECT query_id, 0 AS step, CAST([] AS VARCHAR[][]) AS kept, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT query_id FROM worded)
  UNION ALL
  SELECT query_id, step + 1, CASE WHEN new THEN list_append(kept, w) ELSE kept END, CASE WHEN new THEN list_append(ids, chunk_id) ELSE ids END
  FROM (SELECT k.*, h.w, h.chunk_id, h.chunk_id IS NOT NULL AND len(list_filter(k.kept, lambda s: len(s) > 0 AND len(h.w) > 0 AND
          len(list_intersect(s, h.w)) / (len(s) + len(h.w) - len(list_intersect(s, h.w))) >= 0.9)) = 0 AS new
        FROM walk k LEFT JOIN worded h ON h.query_id = k.query_id AND h.rank = k.step + 1 WHERE k.step < 20)),
kept AS (SELECT query_id, unnest(ids) AS chunk_id FROM walk WHERE step = 20),
rated AS (SELECT w.*, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, w)) / len(qw) ELSE 0.0 END AS overlap FROM worded w JOIN kept USING (query_id, chunk_id))
SELECT query_id, chunk_id, document_id, title, ROUND(overlap, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS INTEGER) AS rank FROM rated QUALIFY rank <= 10
""".replace("ORDER BY overlap DESC, rank) AS INTEGER) AS rank FROM rated QUALIFY rank <= 10",
            "ORDER BY overlap DESC, rated.rank) AS INTEGER) AS rank FROM rated QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rated.rank) <= 10"))
def retrieved_fixed(t):
    """Benchmark passages against fixed chunks, through all steps, with counts of letters as vectors."""
    def letters(text):
        return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])

    base = t.documents.select(F.col("doc_id").alias("document_id"), "text", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    chunks = cut_lineage(docs.embed(docs.chunk_fixed(base), letters).drop("metadata"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), letters(F.col("text")).alias("query_vector"))
    out = ret.retrieve(asked, chunks, ret.RetrievalConfig(rerank=True))
    return out.select("query_id", "chunk_id", "document_id", "title", "rank", F.round("score", 6).alias("score"))


@query("ret5_retrieve")
def retrieved(t):
    """Each benchmark passage as a question against every document chunk, through all steps."""
    out = ret.retrieve(benchmark_queries(t), document_chunks(t), ret.RetrievalConfig(rerank=True))
    return out.select("query_id", "chunk_id", "document_id", "title", "rank", F.round("score", 6).alias("score"))
