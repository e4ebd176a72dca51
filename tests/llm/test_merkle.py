"""Hash trees against a plain walk, and the query against its SQL."""

import hashlib
import itertools
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import documents  # noqa: E402

from ledgerlight.llm.merkle import fold, leaf_hash, manifest, siblings  # noqa: E402
from ledgerlight.llm.op11 import SQL, merkle  # noqa: E402
from ledgerlight.llm.ordering import numbered  # noqa: E402

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in NAMES])


def plain_tree(hashes, fanout):
    """The root, and for every leaf the siblings left and right of its path, level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, path in enumerate(paths):
            first = at[i] // fanout * fanout
            run = level[first:first + fanout]
            path.append(("".join(run[:at[i] - first]), "".join(run[at[i] - first + 1:])))
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], paths


def plain_manifest(rows, fanout):
    out, subroots = [], []
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        root, paths = plain_tree([plain_leaf(r) for r in mine], fanout)
        subroots.append(root)
        out.append([(r["doc_id"], plain_leaf(r), p) for r, p in zip(mine, paths)])
    root, above = plain_tree(subroots, fanout)
    return sorted((repr((i, leaf, p + up, sub, root)) for group, sub, up in zip(out, subroots, above) for i, leaf, p in group))


def awkward(spark, seed=0):
    texts = [None, "", "é" * 3, "a\nb", "x" * 20000, "same", "same", *[f"text {i}" for i in range(30)]]
    langs = ["en" if i % 3 else None for i in range(len(texts) - 5)] + ["de", "é", "", "zz", "zz"]
    ids = [5 * i - 20 for i in range(len(texts) - 3)] + [None, 7, 7]
    return documents(spark, texts, langs, [None if i % 4 == 0 else f"s{i}" for i in range(len(texts))], ids)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_like_brute_force(spark, fanout):
    docs = awkward(spark).repartition(5)
    docs = docs.unionAll(docs.filter("doc_id = 5"))  # a row that stands there twice
    found = manifest(docs, [F.col(c) for c in NAMES], F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")}, fanout)
    checked = found.withColumn("folds", fold(F.col("leaf"), F.col("path")) == F.col("root")).collect()
    got = sorted(repr((r["row"]["doc_id"], r["leaf"], [(p["left"], p["right"]) for p in r["path"]], r["subroot"], r["root"]))
                 for r in checked)
    assert got == plain_manifest([r.asDict() for r in docs.collect()], fanout)
    assert all(r["folds"] for r in checked)


def test_lone_leaves_and_nothing(spark):
    columns = [F.col(c) for c in NAMES]
    one = documents(spark, ["a"])
    row = manifest(one, columns, F.col("lang"), F.col("doc_id")).first()
    assert row["leaf"] == row["subroot"] == row["root"] == plain_leaf(one.first().asDict()) and row["path"] == []
    assert manifest(one.filter("false"), columns, F.col("lang"), F.col("doc_id")).count() == 0
    two = manifest(documents(spark, ["a", "b"], ["x", "y"]), columns, F.col("lang"), F.col("doc_id")).collect()
    assert {r["root"] for r in two} == {h(*[r["subroot"] for r in sorted(two, key=lambda r: r["row"]["order"])])}


def test_a_change_is_found_out(spark):
    docs = awkward(spark)
    changed = [F.col(c) if c != "text" else F.concat("text", F.lit("!")) for c in NAMES]
    keep = {"other": leaf_hash(changed), "text": F.col("text")}
    found = manifest(docs, [F.col(c) for c in NAMES], F.col("lang"), F.col("doc_id"), keep).select(
        (fold(F.col("row.other"), F.col("path")) == F.col("root")).alias("same"), "row.text", siblings(F.col("path")).alias("s"))
    assert all(r["same"] == (r["text"] is None) and len(r["s"]) % 64 == 0 for r in found.collect())


def test_query_like_its_sql(spark, tmp_path):
    import duckdb

    docs = awkward(spark).select(*NAMES)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(repr(tuple(r)) for r in merkle(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas().assign(doc_id=lambda p: p.doc_id.astype("Int64"), n_chars=lambda p: p.n_chars.astype("Int64")))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = sorted(repr(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({SQL})").fetchall())
    assert got == want


def test_positions_with_many_equal_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"),
                                    F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("o"), "id")
    got = numbered(rows.repartition(7), "g", ["o"]).collect()
    for g, group in itertools.groupby(sorted(got, key=lambda r: (r["g"], r["pos"])), key=lambda r: r["g"]):
        group = list(group)
        assert [r["pos"] for r in group] == list(range(len(group))) and {r["n"] for r in group} == {len(group)}
        assert [r["o"] for r in group] == sorted(r["o"] for r in group)
