"""Files to searchable chunks: admission, text, records, chunking, embedding and storage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import text as tx
from ledgerlight.functions.binding import bind
from ledgerlight.session import spread

# Limits and formats of an upload.
MAX_DOCUMENT_BYTES = 50 * 1024 * 1024
EXTENSIONS = (".pdf", ".txt", ".md", ".csv", ".xlsx", ".docx")
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")

# Vector width and input limit of known embedding models.
EMBEDDING_MODELS = {
    "nomic-embed-text": {"dimension": 768, "max_tokens": 8192},
    "all-MiniLM-L6-v2": {"dimension": 384, "max_tokens": 256},
    "all-mpnet-base-v2": {"dimension": 768, "max_tokens": 384},
    "text-embedding-3-small": {"dimension": 1536, "max_tokens": 8191},
    "text-embedding-3-large": {"dimension": 3072, "max_tokens": 8191},
}
HASH_DIMENSION = 256
# Kinds of files whose bytes are text.
TEXT_EXTENSIONS = (".txt", ".md", ".csv")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as (filename, content, size_bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content",
                        F.col("length").alias("size_bytes"))


def suffix(filename: Column | str) -> Column:
    c = F.col(filename) if isinstance(filename, str) else filename
    return F.lower(F.regexp_extract(c, r"^.*[^/](\.[^./]+)$", 1))


def stem(filename: Column | str) -> Column:
    c = F.col(filename) if isinstance(filename, str) else filename
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def admission_reason(filename: str = "filename", content: str = "content", text: str | None = None,
                     extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_DOCUMENT_BYTES) -> Column:
    """Null for a file that may be ingested, else why not; extension first, then size, then text."""
    reason = (F.when(~suffix(filename).isin(*extensions), F.concat(F.lit("unsupported file type: "), suffix(filename)))
              .when(F.octet_length(content) > max_bytes, F.lit("file too large")))
    if text is not None:
        readable = suffix(filename).isin(*TEXT_EXTENSIONS)
        reason = (reason.when(F.col(text).isNull() & ~readable, F.concat(F.lit("no extractor for "), suffix(filename)))
                  .when(F.col(text).isNull() & F.col(content).isNotNull(), F.lit("not valid UTF-8"))
                  .when(tx.strip(F.coalesce(F.col(text), F.lit(""))) == "", F.lit("no text content")))
    return reason


def admit_documents(df: DataFrame, text: str | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """The admitted files, and the rejected ones with a ``reason``."""
    judged = df.withColumn("reason", admission_reason(text=text, **limits))
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def decode_text(df: DataFrame, content: str = "content", name: str = "text") -> DataFrame:
    """Adds the text of plain files: UTF-8 for .txt and .md, a Markdown table for .csv.

    Formats that need a parser of their own stay null, and so do files that are not UTF-8; an
    extractor for the former is a pandas UDF that fills the same column.
    """
    kind = suffix("filename")
    body = F.try_validate_utf8(F.col(content).cast("string"))
    return df.withColumn(
        name, F.when(kind.isin(".txt", ".md"), body).when(kind == ".csv", csv_to_markdown_text(F.when(kind == ".csv", body))))


# One field of CSV: quoted, with whatever follows the closing quote, or plain. Possessive, so long fields cost no stack.
_FIELD = r'(?:"(?:[^"]++|"")*+"?[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'


def csv_rows(text: Column | str) -> Column:
    """CSV text as an array of rows of fields; blank lines are no rows.

    A field that begins with a quote goes to the closing one, line ends and doubled quotes included; a quote elsewhere is
    a character like any other.
    """
    c = F.col(text) if isinstance(text, str) else text
    records = F.filter(F.regexp_extract_all(c, F.lit(f"({_FIELD}(?:,{_FIELD})*+)"), F.lit(1)), lambda r: r != "")
    whole = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'

    def plain(field: Column) -> Column:
        inside = F.replace(F.regexp_extract(field, whole, 1), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(field, F.lit('"')), F.concat(inside, F.regexp_extract(field, whole, 2))).otherwise(field)

    # With a comma before it every field begins alike; the comma itself is left out by the group.
    return F.transform(records, lambda r: F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(f",({_FIELD})"), F.lit(1)), plain))


def csv_to_markdown_text(text: Column | str) -> Column:
    """CSV text as a Markdown table whose head is the first row; empty for no rows, null for null."""
    def line(fields: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(fields, " | "), F.lit(" |"))

    def table(rows: Column) -> Column:
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
        lines = F.transform(rows, line)
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.get(lines, F.lit(0)), rule), rest), "\n")).otherwise("")

    return bind(csv_rows(text), lambda rows: F.when(rows.isNotNull(), table(rows)))


def csv_to_markdown(df: DataFrame, file: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of many files to one Markdown table per file: (file, text).

    What is gathered per file is bounded by the admission limit on its size.
    """
    def line(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    row = line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    body = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("line"))))
    head = F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "---|" * len(columns)))
    return (df.groupBy(file).agg(body.alias("_rows"))
            .select(file, F.array_join(F.concat(head, F.transform("_rows", lambda r: r["line"])), "\n").alias("text")))


def document_records(df: DataFrame, metadata: str | None = None) -> DataFrame:
    """Adds title, content_hash, size_bytes, mime_type and the merged ``metadata`` map."""
    mime = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    out = (df.withColumn("title", stem("filename"))
           .withColumn("content_hash", F.sha2("content", 256))
           .withColumn("size_bytes", F.octet_length("content"))
           .withColumn("mime_type", F.try_element_at(mime, suffix("filename"))))
    own = F.create_map(F.lit("filename"), F.col("filename"), F.lit("content_hash"), F.col("content_hash"),
                       F.lit("size_bytes"), F.col("size_bytes").cast("string"), F.lit("mime_type"), F.col("mime_type"))
    if metadata is None:
        return out.withColumn("metadata", own)
    given = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")),
                         lambda k, _v: ~F.map_contains_key(own, k))
    return out.withColumn("metadata", F.map_concat(given, own))


def fixed_windows(text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before.

    The text is cut once into steps, and a window is a step and the head of the next ones, so
    the work is linear in the text however long it is.
    """
    c = F.col(text) if isinstance(text, str) else text
    step = size - overlap
    steps = F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    ahead = -(-overlap // step)
    windows = bind(steps, lambda all_steps: F.transform(all_steps, lambda s, i: F.substring(
        F.concat(s, *[F.coalesce(F.get(all_steps, i + j), F.lit("")) for j in range(1, ahead + 1)]), 1, size)))
    n = F.char_length(c)
    # A trailing step that lies wholly in the overlap adds nothing new.
    count = F.when(n <= size, F.least(n, F.lit(1))).otherwise(F.ceil((n - overlap) / F.lit(step)))
    return F.slice(windows, F.lit(1), count.cast("int"))


def _packed(lengths: Column, size: int, overlap: int) -> Column:
    """Spans (``start``, ``length``, ``long``) of neighbouring pieces of the given lengths, packed up to ``size``.

    A piece of ``size`` or more is a span of its own, marked ``long``. The next span starts with as many of the last
    pieces of the one before as fit in ``overlap`` and beside the piece that did not. One fold over the pieces, whose
    state is the lengths of the span being filled.
    """
    spans = "array<struct<start:int,length:int,long:boolean>>"

    def span(start: Column, length: Column, long: bool) -> Column:
        return F.array(F.struct(start.alias("start"), length.alias("length"), F.lit(long).alias("long")))

    def state(out: Column, start: Column, length: Column, held: Column) -> Column:
        return F.struct(out.alias("out"), start.alias("start"), length.alias("length"), held.alias("held"))

    none = F.lit(0)
    nothing = F.array().cast("array<int>")
    first = state(F.array().cast(spans), none, none, nothing)

    def shortened(s: Column, piece: Column) -> Column:
        """What stays of the span for the next one: characters, and how many pieces go from its front."""
        def too_long(left: Column) -> Column:
            return (left > overlap) | ((left > 0) & (left + piece > size))

        return F.aggregate(s["held"], F.struct(s["length"].alias("left"), none.alias("gone")), lambda a, x: F.when(
            too_long(a["left"]), F.struct((a["left"] - x).alias("left"), (a["gone"] + 1).alias("gone"))).otherwise(a))

    def add(s: Column, piece: Column) -> Column:
        filled = F.when(s["length"] > 0, F.concat(s["out"], span(s["start"], s["length"], False))).otherwise(s["out"])
        end = s["start"] + s["length"]
        alone = state(F.concat(filled, span(end, piece, True)), end + piece, none, nothing)
        fits = state(s["out"], s["start"], s["length"] + piece, F.concat(s["held"], F.array(piece)))
        cut = bind(shortened(s, piece), lambda k: state(
            filled, end - k["left"], k["left"] + piece, F.concat(F.slice(s["held"], k["gone"] + 1, F.size(s["held"])), F.array(piece))))
        return F.when(piece >= size, alone).when((s["length"] > 0) & (s["length"] + piece > size), cut).otherwise(fits)

    return F.aggregate(lengths, first, add, lambda s: F.when(
        s["length"] > 0, F.concat(s["out"], span(s["start"], s["length"], False))).otherwise(s["out"]))


def recursive_chunks(text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that does; null for null.

    A text is cut before each of the first separator, which stays at the front of its piece. Short neighbours are packed
    together; a piece that is still too long is cut by the next separator, one level of the expression for each. The
    empty separator cuts between any two characters. Chunks are stripped, and empty ones left out.
    """
    c = F.col(text) if isinstance(text, str) else text

    def stripped(chunks: Column) -> Column:
        return F.filter(F.transform(chunks, tx.strip), lambda x: x != "")

    def level(whole: Column, at: int) -> Column:
        if at == len(separators):
            return F.array(whole)
        separator = separators[at]
        if not separator:
            return stripped(fixed_windows(whole, size, overlap))
        parts = F.split(whole, re.sub(r"(\W)", r"\\\1", separator), -1)
        lengths = F.filter(F.transform(parts, lambda p, i: F.char_length(p) + F.when(i > 0, len(separator)).otherwise(0)),
                           lambda n: n > 0)

        def chunks(s: Column) -> Column:
            return bind(F.substring(whole, s["start"] + 1, s["length"]), lambda piece: F.when(
                s["long"], level(piece, at + 1)).otherwise(stripped(F.array(piece))))

        return F.flatten(F.transform(_packed(lengths, size, overlap), chunks))

    return F.when(c.isNotNull(), bind(c, lambda whole: level(whole, 0)))


def _chunk(df: DataFrame, pieces: Column, document_id: str) -> DataFrame:
    """One row per chunk; count, parent metadata and title ride along, nothing is shuffled."""
    keep = [c for c in df.columns if c not in ("text", "content", "metadata", document_id)]
    meta = F.map_concat(F.map_filter("metadata", lambda k, _v: k != "document_title"),
                        F.create_map(F.lit("document_title"), F.col("title"))) \
        if {"metadata", "title"} <= set(df.columns) else F.lit(None).cast("map<string,string>")
    # Each chunk carries its number and the count, so the cut stands in the plan once and is worked out once.
    numbered = bind(pieces, lambda all_: F.transform(all_, lambda x, i: F.struct(
        F.size(all_).alias("chunk_count"), i.alias("chunk_index"), x.alias("content"))))
    cut = df.select(document_id, *keep, meta.alias("metadata"), F.explode(numbered).alias("_c"))
    return cut.select(document_id, *keep, "metadata", "_c.chunk_count", "_c.chunk_index", "_c.content") \
        .withColumn("chunk_id", F.concat_ws("-", F.col(document_id).cast("string"), F.col("chunk_index").cast("string")))


def chunk_fixed(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text",
                document_id: str = "document_id") -> DataFrame:
    return _chunk(df, fixed_windows(text, size, overlap), document_id)


def chunk_recursive(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text",
                    document_id: str = "document_id") -> DataFrame:
    return _chunk(spread(df), recursive_chunks(text, size, overlap), document_id)


def chunk_stats(chunks: DataFrame, document_chars: DataFrame, strategy: str, document_id: str = "document_id") -> DataFrame:
    """Chunk count, average size, and the share of chunk text that repeats earlier text.

    ``document_chars`` has document_id and n_chars; repeated text is what the chunks hold
    beyond the document itself.
    """
    per_document = chunks.groupBy(document_id).agg(F.count(F.lit(1)).alias("_n"),
                                                   F.sum(F.char_length("content")).alias("_chars"))
    joined = per_document.join(document_chars, document_id)
    repeated = F.sum(F.greatest(F.col("_chars") - F.col("n_chars"), F.lit(0)))
    total = F.sum("_chars")
    return joined.agg(
        F.lit(strategy).alias("strategy"), F.sum("_n").alias("chunk_count"),
        (total / F.sum("_n")).alias("avg_chunk_size"),
        F.when(total > 0, repeated / total).otherwise(0.0).alias("overlap_ratio"))


def hashed_terms(df: DataFrame, text: str = "content", name: str = "embedding", dimension: int = HASH_DIMENSION) -> DataFrame:
    """Adds a unit vector of hashed term counts; the embedding used when no model is given."""
    from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    words = Tokenizer(inputCol=text, outputCol="_words").transform(df)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimension).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counts)
    return unit.withColumn(name, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def embed(df: DataFrame, provider: Callable[[Column], Column] | None = None, text: str = "content",
          name: str = "embedding") -> DataFrame:
    """Adds the vector of each chunk. ``provider`` maps a text column to an array column,
    for example a pandas UDF around a model."""
    if provider is None:
        return hashed_terms(df, text, name)
    return df.withColumn(name, provider(F.col(text)))


def check_dimension(df: DataFrame, model: str, vector: str = "embedding") -> DataFrame:
    """Adds expected width, input limit, actual width and whether they agree."""
    if model not in EMBEDDING_MODELS:
        raise ValueError(f"unknown embedding model: {model}")
    profile = EMBEDDING_MODELS[model]
    return (df.withColumn("expected_dim", F.lit(profile["dimension"]))
            .withColumn("max_tokens", F.lit(profile["max_tokens"]))
            .withColumn("actual_dim", F.size(vector))
            .withColumn("dimension_ok", F.size(vector) == profile["dimension"]))


def ingest(files: DataFrame, document_id: str = "document_id", provider: Callable[[Column], Column] | None = None,
           strategy: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Files to embedded chunks, and the rejected files with their reason."""
    named, badly_named = admit_documents(files)
    admitted, blank = admit_documents(decode_text(named), text="text")
    records = document_records(admitted, "metadata" if "metadata" in files.columns else None)
    cut = (chunk_recursive if strategy == "recursive" else chunk_fixed)(records, size, overlap, document_id=document_id)
    return embed(cut, provider), badly_named.unionByName(blank.drop("text"))


def flatten_metadata(chunks: DataFrame, keys: list[str], document_id: str = "document_id") -> DataFrame:
    """Chunk rows as stored: ids, text, vector, and the named metadata keys as columns."""
    fixed = [document_id, "chunk_id", "chunk_index", "content", "embedding"]
    own = [c for c in ("source",) if c in chunks.columns]
    taken = set(fixed) | set(own)
    return chunks.select(*fixed, *own, *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys if k not in taken])


def drop_documents(chunks: DataFrame, ids: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Chunks of every document not listed in ``ids``."""
    return chunks.join(ids.select(document_id).distinct(), document_id, "left_anti")


def collection_stats(chunks: DataFrame, document_id: str = "document_id") -> DataFrame:
    return chunks.groupBy(document_id).agg(F.count(F.lit(1)).alias("chunk_count"))
