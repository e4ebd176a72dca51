"""Decontamination, line chunks, substring de-duplication and Jaccard groups against brute force."""

import hashlib
import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from fixtures import blank_words, corpus, documents, plain_words  # noqa: E402

from ledgerlight.llm import decontamination, jaccard, line_chunks, suffix_dedup  # noqa: E402
from ledgerlight.llm.induced_sort import sorted_suffixes  # noqa: E402
from ledgerlight.llm.lm_score import pack_counts, pack_sorted, unpack_counts  # noqa: E402


@pytest.mark.parametrize("window,chunk", [(10, 100_000), (3, 20)])
def test_leaks_like_brute_force(spark, window, chunk, monkeypatch):
    texts = corpus(3)
    items = [(0, " ".join(texts[0].split()[:25])), (1, "one two"), (2, None), (3, ""), (4, texts[5] or ""), (4, "a"), (12, "A B!")]
    monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", chunk)
    monkeypatch.setattr(decontamination.build_automata, "__defaults__", (chunk,))
    docs = documents(spark, [*texts, "x one Two y one", "one, two", texts[0].upper()])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.find_leaks(docs, bench, window).collect()}
    windows = {}
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i:i + window]), set()).add(str(item))
    for row in docs.collect():
        words, hit, names = plain_words(row["text"]), set(), set()
        for i in range(len(words)):
            for size in {len(w) for w in windows}:
                if tuple(words[i:i + size]) in windows and i + size <= len(words):
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(words[i:i + size])]
        got = found[row["doc_id"]]
        assert (got["n_words"], got["n_hit"], got["item_ids"]) == (len(words), len(hit), sorted(names))


def test_leaks_go_and_clean_texts_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    texts = [f"Before it, {item.title()}! After it.", item, "nothing here", None, "", item + " x"]
    kept = {r["doc_id"]: r["text"] for r in decontamination.remove_leaks(
        documents(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert kept == {0: "Before it, ! After it.", 2: "nothing here", 3: None, 4: ""}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_leaks(documents(spark, texts), none).count() == len(texts)
    assert decontamination.remove_leaks(documents(spark, []), none).count() == 0


def test_line_chunks_like_brute_force(spark):
    rng = np.random.default_rng(2)
    lines = [f"line {i}" for i in range(30)]
    texts = ["\n".join(lines[i] for i in rng.integers(0, 30, rng.integers(1, 60))) for _ in range(20)]
    block = "\n".join(f"shared {i}" for i in range(40))
    texts += [block, "head\n" + block, "other\nhead\n" + block + "\ntail", block, None, "", "\n", "\n\n\n", "one", "one",
              "\n".join(["same line"] * 50), "\n".join(["same line"] * 50)]
    docs = documents(spark, texts)
    got = {r["row"]["doc_id"]: r for r in line_chunks.drop_repeated(docs).collect()}

    def hashed(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:8], 16)

    seen = set()
    for i, text in enumerate(texts):
        if text is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
            continue
        own = text.split("\n")
        cand = [False, False] + [(hashed(own[k - 1]) + 31 * hashed(own[k - 2])) % 3 == 0 for k in range(2, len(own) + 1)]
        ends = [k for k in range(2, len(own)) if cand[k] and not cand[k - 1]]
        kept, gone = [], 0
        for a, b in zip([0, *ends], [*ends, len(own)]):
            body = "\n".join(own[a:b])
            if b - a > 1 and body in seen:
                gone += b - a
            else:
                kept.append(body)
            if b - a > 1:
                seen.add(body)
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) == ("\n".join(kept), len(own), gone), i
    assert got[22]["n_removed"] > 30, "a passage is found wherever it stands"
    assert line_chunks.drop_repeated(documents(spark, [])).count() == 0


def test_line_chunks_use_no_python(spark):
    plan = line_chunks.drop_repeated(documents(spark, ["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_passages(texts):
    seen, out = {}, []
    for i, text in enumerate(texts):
        own = (text or "").split("\n")
        gone = set()
        for k in range(len(own) - 1):
            doc, at = seen.setdefault((own[k], own[k + 1]), (i, k))
            if doc != i or k > at + 1:
                gone |= {k, k + 1}
        out.append((None if text is None else "\n".join(x for k, x in enumerate(own) if k not in gone), len(gone)))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_passages_like_brute_force(spark, clash, monkeypatch):
    if clash:  # a hash for each few windows: only bytes tell them apart, and a window may meet another's owner
        monkeypatch.setattr(line_chunks.F, "xxhash64", (lambda real: lambda *c: F.pmod(real(*c), F.lit(40)) if len(c) == 2
                                                        else real(*c))(line_chunks.F.xxhash64))
    rng = np.random.default_rng(3)
    lines = [f"line {i}" for i in range(30)]
    texts = ["\n".join(lines[i] for i in rng.integers(0, 30, rng.integers(1, 60))) for _ in range(20)]
    texts += [None, "", "\n", "\n\n\n", "one", "one", "a\nb\na\nb", "\n".join(["same line"] * 50), "\n".join(["same line"] * 50)]
    got = {r["row"]["doc_id"]: r for r in line_chunks.drop_passages(documents(spark, texts)).collect()}
    want = brute_passages(texts)
    if clash:
        assert all(got[i]["n_removed"] <= n for i, (_, n) in enumerate(want)) and any(r["n_removed"] for r in got.values())
        return
    for i, text in enumerate(texts):
        assert (got[i]["text"], got[i]["n_removed"]) == want[i], i
        assert got[i]["n_lines"] == (0 if text is None else text.count("\n") + 1)
    assert line_chunks.drop_passages(documents(spark, [])).count() == 0


def test_short_passages_go_whole_between_other_neighbours(spark):
    passages = {n: [f"passage {n} line {k} of it" for k in range(n)] for n in range(2, 9)}
    texts, ids = [], []
    for doc in range(3):
        for n, body in passages.items():
            texts.append("\n".join([f"own {doc} {n} {k}" for k in range(3)] + body + [f"end {doc} {n} {k}" for k in range(doc)]))
            ids.append(doc * 100 + n)
    frame = line_chunks.drop_passages(documents(spark, texts, ids=ids))
    got = {r["row"]["doc_id"]: r for r in frame.collect()}
    for i, text in zip(ids, texts):
        kept = text if i < 100 else "\n".join(x for x in text.split("\n") if not x.startswith("passage"))
        assert (got[i]["text"], got[i]["n_removed"]) == (kept, 0 if i < 100 else i % 100), i
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, documents(spark, texts, ids=ids), "").collect()}
    assert stage == {i: r["text"] for i, r in got.items()}


def test_suffix_order_like_sorting():
    rng = np.random.default_rng(5)
    for trial in range(150):
        n, limit = int(rng.integers(0, 60)), int(rng.integers(1, 30))
        body = rng.integers(1, rng.integers(2, 6), n)
        body = np.repeat(body, rng.integers(1, 6, n)) if trial % 3 == 0 and n else body
        text = np.concatenate((body, [0])).astype(np.uint16)
        chunks = list(sorted_suffixes(text, limit, held=int(rng.choice([5, 10**6]))))  # five tuples in memory: the rest on disk
        at, common = (np.concatenate([c[k] for c in chunks]).tolist() for k in (0, 1))
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert sorted(at) == list(range(len(text)))
        assert [text[i:i + limit].tolist() for i in at] == [text[i:i + limit].tolist() for i in plain]
        for k in range(1, len(at)):
            a, b = text[at[k - 1]:].tolist(), text[at[k]:].tolist()
            same = next((j for j in range(limit) if j >= min(len(a), len(b)) or a[j] != b[j]), limit)
            assert common[k] == same


@pytest.mark.parametrize("hot,piece,low,step", [(5_000, 1 << 20, 0, 1), (2, 300, -20, 1), (5_000, 300, -(2**40), 2**35)])
def test_repeats_like_brute_force(spark, hot, piece, low, step, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    texts = corpus(4, n=40)
    texts += ["é" * 60, "ab" + "é" * 60, "q" * 49, "q" * 49, "q" * 50, "q" * 70, texts[0], texts[0], "\x00\x01" * 40, "z\x00\x01" * 40]
    ids = [low + step * i for i in range(len(texts) - 2)] + [None, low + step * len(texts) * 2]
    rng = np.random.default_rng(0)
    order = rng.permutation(len(texts))
    docs = documents(spark, [texts[k] for k in order], ids=[ids[k] for k in order]).repartition(3)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, with_bytes=True).collect()}
    seen = set()
    for i, text in sorted(zip(ids, texts), key=lambda x: (x[0] is None, x[0] or 0)):
        body = (text or "").encode()
        starts = [p for p in range(len(body) - 49) if body[p:p + 50] in seen]
        seen |= {body[p:p + 50] for p in range(len(body) - 49)}
        gone = {q for p in starts for q in range(p, p + 50)}
        kept = bytes(c for k, c in enumerate(body) if k not in gone)
        want = (len(body), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest(), kept)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"], bytes(got[i]["kept"])) == want, i
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_anchors_are_dealt_evenly_to_shards():
    data = np.random.default_rng(1).integers(97, 123, 400_000).astype(np.uint8)
    keys = suffix_dedup.block_anchors(data, np.arange(0, 400_001, 4_000))[0]
    held = np.bincount((keys >> np.uint64(60)).astype(np.int64), minlength=16)
    assert held.max() < 1.2 * held.mean() and held.min() > 0.8 * held.mean()


def test_strings_that_stand_alone_are_not_sorted(monkeypatch):
    rng, sorted_bytes, real = np.random.default_rng(2), [], suffix_dedup.first_documents
    monkeypatch.setattr(suffix_dedup, "first_documents", lambda data, *x: (sorted_bytes.append(len(data)), real(data, *x))[1])
    noise = [rng.bytes(20) for _ in range(8)]
    gram, passage = rng.bytes(20), rng.bytes(52)
    # Of each block a context of two anchors: one stands between other bytes everywhere, the other in 52 equal ones.
    held = [(noise[2 * k] + gram + noise[2 * k + 1], noise[k][:k] + passage + noise[k][k:8]) for k in range(3)]
    earliest = [(7, 5), (2, 9), (4, 4)]
    group = pd.DataFrame({
        "block": [str(k) for k in range(3)], "part": 0, "keys": [pack_sorted(np.array([11, 12], np.uint64))] * 3,
        "lengths": [pack_counts(np.array([len(x) for x in own])) for own in held],
        "earliest": [pack_counts(np.array(e)) for e in earliest],
        "bytes": [suffix_dedup._squeeze(b"".join(own)) for own in held]})
    firsts = {r.block: np.repeat(unpack_counts(r.firsts), unpack_counts(r.runs)).tolist()
              for r in suffix_dedup._resolve(group).itertuples()}
    for k, (alone, own) in enumerate(earliest):
        assert firsts[str(k)] == [alone] * 11 + [own] * k + [4] * 3 + [own] * (8 - k)
    assert sum(sorted_bytes) == 3 * 52


def brute_groups(texts, ids, width, num, den):
    sets = []
    for text in texts:
        words = blank_words(text)
        sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {ids[k]: (len(sets[k]), min(ids[j] for j in range(len(texts)) if root[j] == root[k])) for k in range(len(texts))}


@pytest.mark.parametrize("width,num,light,block", [(3, 90, 64, 1024), (5, 80, 64, 3), (2, 70, 2, 2)])
def test_groups_like_brute_force(spark, width, num, light, block, monkeypatch):
    monkeypatch.setattr(jaccard, "LIGHT_END", light)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    rng = np.random.default_rng(9)
    texts = corpus(6, n=35)
    base = [f"w{i}" for i in range(120)]
    for _ in range(40):  # near copies of one text, most of them too far from one another
        copy = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 5))):
            copy[k] = f"z{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    for size in (1, 2, 3, 4, 8, 9, 10, 11, 12, 19, 20, 21, 30):  # light sets, one word apart and equal
        own = [f"s{size}_{i}" for i in range(size)]
        texts += [" ".join(own), " ".join([*own, "more"]), " ".join([*own[:-1], "else"]), " ".join(own)]
    ids = rng.permutation(len(texts)).tolist()
    docs = documents(spark, texts, ids=ids)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs, width, num, 100).collect()}
    assert got == brute_groups(texts, ids, width, num, 100)


@pytest.mark.parametrize("power", [10, 12])
def test_long_words_are_told_apart(spark, power):
    """Words whose polynomial hashes modulo a power of two are equal for every base."""
    bits = [bin(i).count("1") % 2 for i in range(1 << power)]
    first, second = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [f"one two {w} three four" for w in (first, second, first)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(documents(spark, texts), 3, 90, 100).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_one_of_each_keeps_columns_and_clean_texts(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base + " more", "another text with words of its own", None, "", base, None]
    kept = jaccard.one_of_each(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 6] and kept.columns == documents(spark, []).columns
    assert jaccard.one_of_each(documents(spark, [])).count() == 0


def test_chunks_meet_by_digest_and_no_text_is_sorted(spark):
    plan = line_chunks.drop_repeated(documents(spark, ["a\nb", "a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "first_body" not in plan and "ShuffledHashJoin" in plan


def test_chunks_of_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    real, digest = line_chunks.F.xxhash64, line_chunks.F.sha2
    texts = ["\n".join(f"text {i % 7} line {k}" for k in range(40)) for i in range(10)]
    texts += ["x\ny", "x\ny", "z\ny", None, "one"]
    docs = documents(spark, texts)
    want = {r["row"]["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_chunks.drop_repeated(docs).collect()}
    assert want[6][2] == want[10][2] == want[12][2] == 0 and want[11][2] == 2 and all(want[i][2] > 30 for i in (7, 8, 9))
    # One hash, then two, for all bodies: whichever way bodies are hashed, equal hashes are not equal bodies.
    for few in (1, 2):
        monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(few)))
        monkeypatch.setattr(line_chunks.F, "sha2", lambda c, bits: digest(F.pmod(real(c), F.lit(few)).cast("string"), bits))
        got = {r["row"]["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_chunks.drop_repeated(docs).collect()}
        assert got == want
