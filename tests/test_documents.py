import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import documents as docs


@pytest.fixture()
def files(spark):
    def make(rows):
        return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "document_id int, filename string, content binary")

    return make


def test_names(one):
    for name, suffix, stem in (("a/b.TXT", ".txt", "b"), ("x.tar.gz", ".gz", "x.tar"), ("noext", "", "noext"), (".hidden", "", ".hidden")):
        assert one(docs.suffix("n"), n=name) == suffix and one(docs.stem("n"), n=name) == stem


def test_admission(files):
    df = files([("a.txt", b"hello"), ("b.exe", b"x"), ("c.md", b"y" * 200), ("d.txt", b"  \n ")])
    ok, bad = docs.admit_documents(docs.decode_text(df), text="text", max_bytes=100)
    assert [r.filename for r in ok.collect()] == ["a.txt"]
    assert {r.filename: r.reason for r in bad.collect()} == {
        "b.exe": "unsupported file type: .exe", "c.md": "file too large", "d.txt": "no text content"}


def test_default_limit_is_fifty_megabytes(spark):
    big = spark.range(1).select(F.lit("a.txt").alias("filename"), F.expr("repeat('x', 60 * 1024 * 1024)").cast("binary").alias("content"))
    assert docs.admit_documents(big)[0].count() == 0


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grüße".encode())
    (tmp_path / "t.csv").write_text('name,note\nann,"x, y"\nbob,z\n')
    rows = {r.filename: r for r in docs.decode_text(docs.scan_documents(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "grüße" and rows["a.txt"].size_bytes == 7
    assert rows["t.csv"].text == "| name | note |\n|---|---|\n| ann | x, y |\n| bob | z |"


def test_csv_like_the_standard_reader(spark):
    import csv
    import io

    rng = random.Random(12)
    pieces = ["a", "b c", ",", ",", "\n", "\n", "\r\n", '"', '""', '"x, y"', '"two\nlines"', '"say ""hi"""', "é", " ", 'in"side', '"end"more']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["", "\n\n", "one", '""', ",", "a,\n,b", '"open', '"' + "long " * 20_000 + '",z', "h\n" + "x" * 100_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", docs.csv_rows("text").alias("rows"), docs.csv_to_markdown_text("text").alias("md"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        text = texts[r.i]
        if text is None:
            assert r.rows is None and r.md is None
            continue
        want = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
        assert r.rows == want, text
        lines = ["| " + " | ".join(row) + " |" for row in want]
        assert r.md == ("\n".join([lines[0], "|" + "---|" * len(want[0]), *lines[1:]]) if want else "")


def test_records(files):
    row = docs.document_records(files([("in/q3.report.txt", b"abc")])).first()
    assert (row.title, row.size_bytes, row.mime_type) == ("q3.report", 3, "text/plain")
    assert row.content_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert row.metadata["filename"] == "in/q3.report.txt"


@pytest.mark.parametrize("size, overlap", [(1000, 200), (10, 3), (10, 7), (5, 0)])
def test_fixed_windows_match_slicing(spark, size, overlap):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n😀é") for _ in range(n)) for n in (0, 1, 4, 5, 9, 10, 11, 17, 18, 31, 999, 1000, 1001, 1200, 1201, 3456)]
    df = spark.createDataFrame(list(enumerate(texts)), ["i", "text"])
    for row in df.select("text", docs.fixed_windows("text", size, overlap).alias("w")).collect():
        want, start = [], 0
        while start < len(row.text) and (start == 0 or start + overlap < len(row.text)):
            want.append(row.text[start:start + size])
            start += size - overlap
        assert row.w == want


def plain_split(text, size, overlap, separators=docs.SEPARATORS):
    """Recursive splitting of one text, step by step."""
    at = next(i for i, s in enumerate(separators) if not s or s in text or i == len(separators) - 1)
    separator, finer = separators[at], separators[at + 1:]
    head, *tail = text.split(separator) if separator else list(text) or [""]
    chunks, held = [], []

    def emit(pieces):
        if "".join(pieces).strip():
            chunks.append("".join(pieces).strip())

    for piece in [p for p in [head, *(separator + t for t in tail)] if p]:
        if len(piece) >= size:
            emit(held)
            held = []
            chunks.extend(plain_split(piece, size, overlap, finer) if finer else [piece])
            continue
        if held and len("".join(held)) + len(piece) > size:
            emit(held)
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    emit(held)
    return chunks


def split(spark, texts, size=1000, overlap=200, separators=docs.SEPARATORS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cut = df.select("i", docs.recursive_chunks("text", size, overlap, separators).alias("c"))
    assert "Python" not in cut._jdf.queryExecution().executedPlan().toString()
    return [r.c for r in cut.orderBy("i").collect()]


def test_recursive_split(spark):
    text = "Chunk 1. " * 100 + "Chunk 2. " * 100
    chunks, *rest = split(spark, [text, "", "short", "a" * 2500, None, " \n "])
    assert len(chunks) > 1 and all(0 < len(c) <= 1000 for c in chunks)
    assert rest == [[], ["short"], ["a" * 1000, "a" * 1000, "a" * 900], None, []]
    assert split(spark, ["aa bb cc dd"], 5, 3) == [["aa bb", "cc", "dd"]]
    assert split(spark, ["one\n\ntwo\n\nthree"], 9, 0) == [["one\n\ntwo", "three"]]
    assert split(spark, ["aa bb cc dd"], 6, 3) == [["aa bb", "bb cc", "cc dd"]]


def test_recursive_split_keeps_every_word(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(50):
        words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 300))]
        texts.append("".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "\n\n\n"]) for w in words))
    for text, chunks in zip(texts, split(spark, texts, 80, 20)):
        assert all(len(c) <= 80 for c in chunks)
        joined = " ".join(chunks)
        assert all(w in joined for w in text.replace(". ", " ").split())


@pytest.mark.parametrize("size,overlap,separators", [(80, 20, docs.SEPARATORS), (30, 0, docs.SEPARATORS), (25, 24, docs.SEPARATORS),
                                                     (40, 10, ("|", ".*", " ")), (12, 5, ("",))])
def test_recursive_split_step_by_step(spark, size, overlap, separators):
    rng = random.Random(size)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 3, 8, 30, 100]))) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n", "\n\n\n", "|", ".*", " \t "]) for w in words))
    assert split(spark, texts, size, overlap, separators) == [plain_split(t, size, overlap, separators) for t in texts]


def test_chunks_are_numbered_and_carry_metadata(files):
    made = docs.decode_text(docs.document_records(files([("a.txt", b"This is a test document. " * 50)])))
    rows = docs.chunk_recursive(made).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) > 1
    assert all(r.chunk_count == len(rows) and r.metadata["document_title"] == "a" for r in rows)


def test_embedding_is_a_unit_vector_and_providers_plug_in(spark):
    df = spark.createDataFrame([("a b b",), ("b a b",), ("zzz",)], ["content"])
    rows = docs.embed(df).collect()
    assert rows[0].embedding == rows[1].embedding != rows[2].embedding
    assert sum(x * x for x in rows[0].embedding) == pytest.approx(1, abs=1e-6)
    own = docs.embed(df, lambda c: F.array(F.char_length(c).cast("float"))).collect()
    assert [r.embedding for r in own] == [[5.0], [5.0], [3.0]]


def test_unknown_embedding_model(spark):
    with pytest.raises(ValueError):
        docs.check_dimension(spark.createDataFrame([([1.0],)], ["embedding"]), "nothing-like-it")


def test_ingest(files):
    df = files([("a.txt", b"Revenue grew. " * 200), ("b.exe", b"x"), ("c.txt", b" "), ("d.md", b"note")])
    chunks, rejected = docs.ingest(df)
    rows = chunks.collect()
    assert {r.document_id for r in rows} == {0, 3} and all(len(r.content) <= 1000 and len(r.embedding) == docs.HASH_DIMENSION for r in rows)
    assert {r.document_id: r.reason for r in rejected.collect()} == {1: "unsupported file type: .exe", 2: "no text content"}
    kept = docs.drop_documents(chunks, df.where("document_id = 0"))
    assert {r.document_id for r in kept.collect()} == {3}
