"""Line de-duplication by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines picks chunk ends, so the ends inside a passage are the same
wherever the passage stands. A chunk of two or more lines whose bytes also stand in an earlier document, or earlier in
the same one, goes; order is by document id, then place. Chunks of one line stay.

Only columns and SQL functions: chunks are made within the row and meet by hash. The bodies of each hash are compared byte
for byte; those of a hash that several bodies have, a clash, are told apart by the bodies themselves.

A chunk that begins or ends outside a repeated passage is not found, so ``drop_passages``, which the pipeline uses, goes by
every window of two lines instead: whatever stretch of two or more lines stands earlier goes, wherever it begins and
ends. Windows in a row that meet the same place of the same document are one match, compared byte for byte line by line.

Empty cases: a null text stays null, an empty one is one empty line; a text that goes whole becomes empty; rows with the
same id and text are treated alike; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.binding import bind
from ledgerlight.session import cut_lineage

#: One line pair in so many is a candidate for a chunk end.
DIVISOR = 3


def whole_row(docs: DataFrame) -> Column:
    """All columns as the struct ``row``, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _chunks(lines: Column) -> Column:
    """Array of (first line, lines, body) of each chunk; line numbers start at 1."""

    def cut(hashes: Column) -> Column:
        n = F.size(hashes)

        def candidate(i: Column) -> Column:
            return F.pmod(F.get(hashes, i - 1) + 31 * F.get(hashes, i - 2), F.lit(DIVISOR)) == 0

        # A candidate right after another one does not count, so no chunk but the last has a single line.
        ends = F.when(n > 2, F.filter(F.sequence(F.lit(2), n - 1), lambda i: candidate(i) & ((i == 2) | ~candidate(i - 1))))
        return bind(F.concat(F.array(F.lit(0)), F.coalesce(ends, F.array().cast("array<int>")), F.array(n)), pieces)

    def pieces(ends: Column) -> Column:
        def piece(k: Column) -> Column:
            first, n = F.get(ends, k - 1) + 1, F.get(ends, k) - F.get(ends, k - 1)
            return F.struct(first.alias("first"), n.alias("n"), F.array_join(F.slice(lines, first, n), "\n").alias("body"))

        return F.transform(F.sequence(F.lit(1), F.size(ends) - 1), piece)

    return bind(F.transform(lines, _line_hash), cut)


def chunks(text: Column) -> Column:
    return bind(F.split(text, "\n"), _chunks)


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.xxhash64(text), F.lit(0)).alias("finger"))


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``finger`` (hash of the text) and ``gone``, the array of first lines of chunks that go."""
    rows = _marked(docs, doc_id, text)
    parts = rows.select("doc_id", "finger", F.explode(chunks(F.col("text"))).alias("c")).filter("c.n > 1").select(
        "doc_id", "finger", F.col("c.first").alias("first"), F.xxhash64("c.body").alias("hash"), F.col("c.body").alias("body"))
    found = cut_lineage(parts.select("doc_id", "finger", "first", "hash", F.lit("").alias("bytes")))
    # Equal bodies become one within the tasks that cut them, so a common one is as little work as a rare one.
    clashes = cut_lineage(parts.select("hash", "body").distinct().groupBy("hash").count().filter("count > 1").select(
        "hash", F.lit(True).alias("clash")))
    if not clashes.isEmpty():
        found = cut_lineage(parts.join(clashes, "hash", "left").select(
            "doc_id", "finger", "first", "hash", F.when(F.col("clash"), F.col("body")).otherwise("").alias("bytes")))
    where = F.struct("doc_id", "finger", "first")
    shared = found.groupBy("hash", "bytes").agg(F.min(where).alias("owner"), F.count("*").alias("times")).filter("times > 1")
    # A document's own list is as long as its text at most.
    return found.join(shared, ["hash", "bytes"]).filter(~where.eqNullSafe(F.col("owner"))).groupBy("doc_id", "finger").agg(
        F.collect_set("first").alias("gone"))


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` without repeated chunks, and ``n_lines``, ``n_removed`` (lines) and all columns of ``docs`` as ``row``."""
    gone = repeated_chunks(docs, doc_id, text)
    rows = docs.select(whole_row(docs), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"))
    # The lists of places are small beside the texts, which need not be sorted to meet them.
    joined = rows.join(gone.hint("shuffle_hash"), F.col("row")[doc_id].eqNullSafe(F.col("doc_id"))
                       & (F.col("mark") == F.col("finger")), "left")
    body = F.col("row")[text]
    all_chunks, none = chunks(body), F.col("gone").isNull()
    kept = F.filter(all_chunks, lambda c: ~F.array_contains("gone", c["first"]))
    return joined.select(
        "row", F.when(none, body).otherwise(F.array_join(F.transform(kept, lambda c: c["body"]), "\n")).alias("text"),
        F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.aggregate(
            F.filter(all_chunks, lambda c: F.array_contains("gone", c["first"])), F.lit(0), lambda n, c: n + c["n"]))
        .cast("long").alias("n_removed"))


def _windows(text: Column) -> Column:
    """Hash of each two lines in a row, in order; null for a text of one line."""
    return bind(F.split(text, "\n"), lambda lines: F.when(F.size(lines) > 1, F.transform(
        F.sequence(F.lit(1), F.size(lines) - 1), lambda i: F.xxhash64(F.get(lines, i - 1), F.get(lines, i)))))


def _matches(marks: Column) -> Column:
    """Windows in order with their owners, joined to (first line, lines, owner) where both sides go on by one line."""

    def starts(at: Column) -> Column:
        def goes_on(i: Column) -> Column:
            one, before = F.get(at, i), F.get(at, i - 1)
            return ((one["first"] == before["first"] + 1) & (one["owner"]["first"] == before["owner"]["first"] + 1)
                    & one["owner"]["doc_id"].eqNullSafe(before["owner"]["doc_id"])
                    & (one["owner"]["finger"] == before["owner"]["finger"]))

        begins = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | ~goes_on(i))
        return bind(F.concat(begins, F.array(F.size(at))), lambda cuts: F.transform(
            F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.struct(
                F.get(at, F.get(cuts, k - 1))["first"].alias("first"),
                (F.get(cuts, k) - F.get(cuts, k - 1) + 1).alias("n"), F.get(at, F.get(cuts, k - 1))["owner"].alias("owner"))))

    return bind(F.array_sort(marks), starts)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``finger`` and ``marks``: first lines of matches and the owner's lines, yet to be compared."""
    rows = _marked(docs, doc_id, text)
    found = cut_lineage(rows.select("doc_id", "finger", F.posexplode(_windows(F.col("text"))).alias("at", "hash")).select(
        "doc_id", "finger", (F.col("at") + 1).alias("first"), "hash"))
    where = F.struct("doc_id", "finger", "first")
    shared = found.groupBy("hash").agg(F.min(where).alias("owner"), F.count("*").alias("times")).filter("times > 1")
    # The window after its owner overlaps it: three equal lines are not two stretches of two.
    own = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("finger") == F.col("owner.finger"))
    marks = found.join(shared, "hash").filter(~own | (F.col("first") > F.col("owner.first") + 1))
    # A document's own list is as long as its text at most.
    matches = marks.groupBy("doc_id", "finger").agg(F.collect_set(F.struct("first", "owner")).alias("marks")).select(
        "doc_id", "finger", F.explode(_matches(F.col("marks"))).alias("m"))
    matches = cut_lineage(matches.select("doc_id", "finger", "m.*"))
    lines = F.slice(F.split("o.text", "\n"), F.col("m.owner.first"), F.col("m.n"))
    held = matches.alias("m").join(rows.alias("o"), F.col("m.owner.doc_id").eqNullSafe(F.col("o.doc_id"))
                                   & (F.col("m.owner.finger") == F.col("o.finger")))
    return held.select("m.doc_id", "m.finger", "m.first", lines.alias("lines")).groupBy("doc_id", "finger").agg(
        F.collect_set(F.struct("first", "lines")).alias("marks"))


def _kept_lines(lines: Column, marks: Column) -> Column:
    """Lines outside the matches whose bytes are equal; of a match with a clash of hashes, each two equal lines go."""

    def spans(mark: Column) -> Column:
        first, n = mark["first"], F.size(mark["lines"])

        def span(begin: Column, end: Column) -> Column:
            return F.struct(begin.alias("first"), end.alias("last"))

        equal = F.filter(F.sequence(F.lit(1), n - 1), lambda k: F.slice(mark["lines"], k, 2) == F.slice(lines, first + k - 1, 2))
        return F.when(mark["lines"] == F.slice(lines, first, n), F.array(span(first, first + n - 1))).otherwise(
            F.transform(equal, lambda k: span(first + k - 1, first + k)))

    def between(bounds: Column) -> Column:
        # Matches share no window, so in order of their first lines their last lines are in order too.
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(
            lines, F.get(bounds, k - 1)["last"] + 1,
            F.greatest(F.get(bounds, k)["first"] - F.get(bounds, k - 1)["last"] - 1, F.lit(0)))))

    def edge(at: Column) -> Column:
        return F.array(F.struct(at.alias("first"), at.alias("last")))

    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(marks, spans))))
    return bind(F.concat(edge(F.lit(0)), gone, edge(F.size(lines) + 1)), between)


def drop_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``drop_repeated``, without any stretch of two or more lines that stands earlier."""
    gone = repeated_passages(docs, doc_id, text)
    rows = docs.select(whole_row(docs), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"))
    joined = rows.join(gone, F.col("row")[doc_id].eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("finger")), "left")
    body = F.col("row")[text]
    kept = F.when(F.col("marks").isNotNull(), bind(F.split(body, "\n"), lambda lines: _kept_lines(lines, F.col("marks"))))
    n_lines = F.coalesce(F.size(F.split(body, "\n")), F.lit(0)).cast("long")
    return joined.select("row", n_lines.alias("n_lines"), kept.alias("kept")).select(
        "row", F.when(F.col("kept").isNull(), body).otherwise(F.array_join("kept", "\n")).alias("text"), "n_lines",
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"))
