import os

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import documents as docs
from ledgerlight.sources import store
from ledgerlight.streaming import ingest

CHUNK = "document_id long, chunk_id string, chunk_index int, content string"


def chunks(spark, documents, text="t", n=3):
    return spark.createDataFrame([(d, f"{d}-{i}", i, f"{text}{d}.{i}") for d in documents for i in range(n)], CHUNK)


def held(store_, version=None):
    out = {}
    for r in store.read_store(store_, version).collect():
        out.setdefault(r.document_id, []).append(r.content)
    return {d: sorted(c) for d, c in out.items()}


def files_of(path):
    return {os.path.join(f, name) for f, _d, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = store.create_store(chunks(spark, range(400)), path, buckets=64)
    before = files_of(f"{path}/data")
    changed, removed = range(0, 400, 40), range(5, 400, 40)
    version = store.change_store(first, chunks(spark, changed, "new", 1), spark.createDataFrame([(d,) for d in removed], "document_id long"))
    assert version == 2
    want = {d: [f"t{d}.{i}" for i in range(3)] for d in range(400) if d not in removed}
    want.update({d: [f"new{d}.0"] for d in changed})
    assert held(first) == want
    old = {d: [f"t{d}.{i}" for i in range(3)] for d in range(400)}
    assert held(first, 1) == old
    ids = spark.createDataFrame([(d,) for d in [*changed, *removed]], "document_id long")
    touched = {r[0] for r in ids.select(first.bucket()).collect()}
    added = files_of(f"{path}/data") - before
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in added} <= touched and len(touched) <= 20
    assert before <= files_of(f"{path}/data")  # nothing is taken away
    same = [b for b, f in first.folders(2).items() if f == first.folders(1).get(b)]
    assert len(same) >= 40 and not set(same) & touched


def test_documents_read_their_buckets_only(spark, tmp_path):
    made = store.create_store(chunks(spark, range(200)), str(tmp_path / "store"), buckets=32)
    wanted = spark.createDataFrame([(3,), (50,), (999,)], "document_id long")
    got = store.read_store(made, documents=wanted)
    assert sorted({r.document_id for r in got.collect()}) == [3, 50]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()}) <= 3


def test_store_from_nothing_to_nothing(spark, tmp_path):
    made = store.create_store(chunks(spark, []), str(tmp_path / "store"), buckets=4)
    assert held(made) == {}
    store.change_store(made, chunks(spark, [1, 2]))
    reopened = store.open_store(spark, str(tmp_path / "store"))
    assert set(held(reopened)) == {1, 2}
    assert store.change_store(reopened, removed=spark.createDataFrame([(1,), (2,), (3,)], "document_id long")) == 3
    assert held(reopened) == {} and set(held(reopened, 2)) == {1, 2} and held(reopened, 1) == {}
    store.change_store(reopened, chunks(spark, [2, 2]))  # ingesting a document twice does not double it
    store.change_store(reopened, chunks(spark, [2]))
    assert held(reopened) == {2: ["t2.0", "t2.1", "t2.2"]}


def test_two_writers_do_not_both_win(spark, tmp_path, monkeypatch):
    made = store.create_store(chunks(spark, [1]), str(tmp_path / "store"), buckets=4)
    store.change_store(made, chunks(spark, [2]))
    monkeypatch.setattr(store.ChunkStore, "version", lambda self: 1)  # a writer that has not seen the second version
    with pytest.raises(Exception, match="already exists"):
        store.change_store(made, chunks(spark, [3]))
    monkeypatch.undo()
    assert set(held(made)) == {1, 2}


def test_one_document_with_most_chunks(spark, tmp_path):
    many = chunks(spark, [7], n=2000).unionAll(chunks(spark, range(20, 30)))
    made = store.create_store(many, str(tmp_path / "store"), buckets=8)
    store.change_store(made, removed=spark.createDataFrame([(20,)], "document_id long"))
    assert store.read_store(made).count() == 2000 + 27


def put(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content)


def run(spark, tmp_path):
    ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "fixed", available_now=True).awaitTermination()
    done = ingest.ingested(spark, str(tmp_path / "out"))
    ledger = sorted((r.path.split("/in/")[1], r.status) for r in done.ledger().collect())
    held = {}
    for r in done.chunks().collect():
        held.setdefault(r.document_id, []).append(r.content)
    return ledger, held, sorted((r.filename, r.reason) for r in done.rejects().collect())


def test_files_are_taken_as_they_arrive(spark, tmp_path):
    day1, day2 = str(tmp_path / "in" / "1"), str(tmp_path / "in" / "2")
    put(day1, "a.txt", b"first text " * 200)
    put(day1, "b.md", b"second")
    put(day1, "copy.txt", b"second")
    put(day1, "bad.exe", b"third")
    put(day1, "blank.txt", b"  ")
    ledger, held, rejects = run(spark, tmp_path)
    assert [s for _f, s in ledger] == ["new", "rejected", "rejected", "new", "repeated"] or \
        sorted(ledger) == sorted([("1/a.txt", "new"), ("1/b.md", "new"), ("1/bad.exe", "rejected"), ("1/blank.txt", "rejected"), ("1/copy.txt", "repeated")])
    assert len(held) == 2 and rejects == [("bad.exe", "unsupported file type: .exe"), ("blank.txt", "no text content")]
    put(day2, "a.txt", b"first text, changed")
    put(day2, "c.txt", b"second")
    put(day2, "third.txt", b"third")  # the content was seen before, under a name that was refused
    ledger, held, rejects = run(spark, tmp_path)
    assert [x for x in ledger if x[0].startswith("2/")] == [("2/a.txt", "changed"), ("2/c.txt", "repeated"), ("2/third.txt", "new")]
    assert len(held) == 4 and all(len(c) == len(set(c)) for c in held.values())
    again = run(spark, tmp_path)
    assert again == (ledger, held, rejects)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    put(str(tmp_path / "in"), "a.txt", b"one " * 700)
    first = run(spark, tmp_path)
    put(str(tmp_path / "in"), "b.txt", b"two")
    second = run(spark, tmp_path)
    commits = tmp_path / "cp" / "commits"
    last = max((p for p in os.listdir(commits) if p.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(commits / name):
            os.remove(commits / name)  # as if the job had died before it could note the batch
    assert run(spark, tmp_path) == second and len(second[1]) == len(first[1]) + 1


def test_stream_equals_batch(spark, tmp_path):
    for i in range(6):
        put(str(tmp_path / "in" / str(i % 2)), f"{i}.txt", f"text number {i} ".encode() * 150)
    _ledger, held, _rejects = run(spark, tmp_path)
    files = docs.scan_documents(spark, str(tmp_path / "in")).withColumn("document_id", F.sha2("content", 256))
    batch = {}
    for r in docs.ingest(files, strategy="fixed")[0].collect():
        batch.setdefault(r.document_id, []).append(r.content)
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in batch.items()}


def test_batches_go_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BATCH_BYTES", 2500)
    for i in range(6):
        put(str(tmp_path / "in" / "1"), f"{i}.txt", f"{i} text ".encode() * 125)
    ledger, held, rejects = run(spark, tmp_path)
    assert [s for _f, s in ledger] == ["new"] * 6 and len(held) == 6 and not rejects
    batches = ingest.ingested(spark, str(tmp_path / "out")).ledger().select("batch").distinct().count()
    assert 2 <= batches <= 3
