"""URL rules, language models, search, mixing and resampling against brute force, or held-out accuracy."""

import math
import os
import random
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import blank_words, corpus, documents, plain_words  # noqa: E402

from ledgerlight.llm import bm25, language, lm_score, mixing, resampling, url_rules  # noqa: E402
from ledgerlight.llm.op1 import RULES  # noqa: E402


def test_urls_by_stated_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q=/de/": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "x://net": ("net", "", None, "allow"), "x://net/": ("net", "/", "net/", "block"),
        "x://badnet/": ("badnet", "/", None, "allow"), "x://example.com/de/a#b": ("example.com", "/de/a", "example.com/de/", "block"),
        "x://m.org/fr/": ("m.org", "/fr/", "org/fr/", "allow"), "x://a?b://c/d": ("a", "", None, "allow"),
        "x://": ("", "", None, "allow"), "no scheme/net/": ("", "", None, "allow"), "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [*enumerate(cases), (None, "x://net/"), (0, "x://net/")]
    pages = spark.createDataFrame([(*r, "<p>", "h") for r in rows], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels, RULES).collect()
    assert Counter((r["page_id"], *r[1:]) for r in got) == Counter((i, *(cases.get(u) if (i, u) != (0, "x://net/") and i is not None
                                                                        else ("net", "/", "net/", "block"))) for i, u in rows)
    assert url_rules.judge(pages.limit(0), labels, RULES).count() == 0


def test_urls_by_mined_rules(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = rng.random() < 0.3
        host = rng.choice(["spam", "ads"]) if bad and rng.random() < 0.8 else rng.choice(["news", "shop", "ads"])
        rows.append((i, f"https://{host}.example.com/{rng.choice(['win', 'buy'] if bad else ['win', 'read'])}/{i}"))
        if i < 250:
            labels.append((i, int(not bad), None))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([*labels, labels[0], (None, 0, 1)], "doc_id long, quality int, toxic int")
    tokens = {i: {f"h:{x}" for x in u.split("/")[2].split(".")} | {f"p:{x}" for x in u.split("/")[3:]} for i, u in rows}
    bad_ids = {r["doc_id"] for r in labels.collect() if r["quality"] == 0}
    from itertools import combinations
    seen, hits = Counter(), Counter()
    for i in range(250):
        for size in (1, 2, 3):
            for part in combinations(sorted(tokens[i]), size):
                seen[part] += 1
                hits[part] += i in bad_ids
    rules = [set(r) for r in seen if hits[r] >= 5 and hits[r] >= 0.6 * seen[r]]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, []).collect()}
    want = {i: "block" if any(r <= tokens[i] for r in rules) else "allow" for i in tokens}
    assert got == want and "block" in want.values()
    kept = [set(r["tokens"]) for r in url_rules.mine_rules(url_rules.labelled_urls(pages, labels)).collect()]
    assert all(not any(a < b for a in kept) for b in kept)


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lm_lists_and_scores_hold_few_arrays():
    """Per n-gram of a hash range and per word of a block, beside what is read and returned."""
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 1 << 50, 100_000, dtype=np.uint64)) for _ in range(8)]
    group = pd.DataFrame({"block": list("abcdefgh"), "part": 0, "keys": [lm_score.pack_sorted(k) for k in keys],
                          "times": [lm_score.pack_counts(np.ones(len(k), np.int64)) for k in keys]})
    assert peak_of(lambda: lm_score.answer_lists(group)) < 40 * sum(map(len, keys))
    counts = np.full(200, 1000)
    words = (rng.zipf(1.3, 200_000) % 30_000).astype(np.uint64) << np.uint64(20)
    vocabulary, _, places = lm_score.listed(words)
    times = lm_score.listed(np.concatenate(lm_score.gram_keys(words, counts, 2, 50)))[1]
    row = {"words": lm_score.pack_counts(counts), "vocabulary": lm_score.pack_counts(vocabulary.astype(np.int64)),
           "places": lm_score.pack_counts(places)}
    answers = [{"part": 0, "counts": lm_score.pack_counts(times)}]
    assert peak_of(lambda: lm_score._log_scores(row, answers, len(words), 2, 2, 50)) < 95 * len(words)


@pytest.mark.parametrize("order,block", [(2, 8 << 20), (3, 3000)])
def test_lm_scores_like_brute_force(spark, order, block):
    texts = corpus(8, n=30, vocabulary=60)
    docs = documents(spark, texts, ids=[*range(len(texts) - 1), 0]).repartition(3)
    rows = lm_score.score(docs, order=order, block_bytes=block, range_bytes=2000).collect()
    words = [blank_words(t) for t in texts]
    counts = Counter(tuple(w[i:i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def prob(w, i, n):
        if n == 1:
            return counts[(w[i],)] / total
        gram = tuple(w[i - n + 1:i + 1])
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= 2 else 0.4 * prob(w, i, n - 1)

    want = sorted((len(w), sum(math.log(prob(w, i, min(order, i + 1))) for i in range(len(w)))) for w in words if w)
    got = sorted((r["n_words"], r["log_sum"]) for r in rows if r["n_words"])
    assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert len(rows) == len(texts) and all((r["score"] is None) == (r["n_words"] == 0) for r in rows)
    assert lm_score.score(documents(spark, [])).count() == 0


@pytest.mark.parametrize("shard,group", [(64 << 20, 16 << 20), (4000, 3000)])
def test_search_like_brute_force(spark, shard, group, monkeypatch):
    texts = corpus(12, n=60, vocabulary=80)
    docs = documents(spark, texts).repartition(2)
    got = bm25.top_documents(docs, F.col("doc_id") % 5 == 0, 4, shard, group).collect()
    words = [plain_words(t) for t in texts]
    df = Counter(w for x in words for w in set(x))
    mean = sum(map(len, words)) / len(words)
    want = []
    for q in range(0, len(texts), 5):
        scores = []
        for d, own in enumerate(words):
            tf = Counter(own)
            s = sum(math.log(1 + (len(texts) - df[w] + .5) / (df[w] + .5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (.25 + .75 * len(own) / mean))
                    for w in set(words[q]) & set(own))
            if s > 0:
                scores.append((-round(s, 6), d))
        want += [(q, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:4])]
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    assert bm25.top_documents(documents(spark, []), F.lit(True)).count() == 0
    assert bm25.top_documents(documents(spark, ["", None]), F.lit(True)).count() == 0


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert mixing.fill_targets([10, 1000, 0], [3, 1, 2]) == [20, 1495, 0]
    assert mixing.fill_targets([0, 0], [3, 1]) == [0, 0] and mixing.fill_targets([], []) == []
    assert mixing.fill_targets([7], [3]) == [10.5]


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        key = mixing.mix(np.array([n], dtype=np.uint64))
        order = mixing.permuted(np.arange(n), np.full(n, n), np.repeat(key, n))
        assert sorted(order.tolist()) == list(range(n)) and order[mixing._place_of_last(n, key[0])] == n - 1


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDER_ROWS", 10)
    texts = corpus(14, n=60)
    sources = [random.Random(i).choice(["b", "a", "a", "a", None, "Z"]) for i in range(len(texts))]
    docs = documents(spark, texts, sources=sources, ids=[*range(len(texts) - 2), 0, None])
    mixed = mixing.mix_sources(docs)
    rows = mixing.taken_words(mixed).collect()
    sizes = Counter()
    for text, source in zip(texts, sources):
        sizes[source] += len(blank_words(text, fold=False))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.fill_targets([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))])))
    assert len(rows) == len(texts) and all(r["taken"] <= 2 * r["size"] for r in rows)
    by_source = Counter()
    for r in rows:
        by_source[(r["source_size"], r["target"])] += r["taken"]
    assert by_source == {(sizes[s], targets[s]): round(targets[s]) for s in order}
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(5))).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    blocks = mixing.packed_blocks(docs, mixed).collect()
    assert all(len(b["text"].split(" ")) == b["n_words"] for b in blocks)
    assert sum(b["n_words"] for b in blocks) == sum(r["taken"] for r in rows)
    known = {w for t in texts for w in blank_words(t, fold=False)}
    assert {w for b in blocks for w in b["text"].split(" ")} <= known
    assert mixing.taken_words(mixing.mix_sources(documents(spark, []))).count() == 0
    assert [r["taken"] for r in mixing.taken_words(mixing.mix_sources(documents(spark, ["", None]))).collect()] == [0, 0]


@pytest.mark.parametrize("total,sources", [(1, 1), (10, 3), (1003, 5), (64, 2)])
def test_shards_are_the_same_however_they_are_split(total, sources):
    counts = np.random.default_rng(total).multinomial(total, np.ones(sources) / sources)
    shards = -(-total // 8)
    whole = mixing.Deal(0, shards, np.zeros_like(counts), counts)
    one = [d for d in mixing.halved(whole, 1, total, 8, 5)]
    two = [d for part in mixing.halved(whole, max(1, shards // 3), total, 8, 5) for d in mixing.halved(part, 1, total, 8, 5)]
    assert [(d.low, d.high, *d.before, *d.counts) for d in one] == [(d.low, d.high, *d.before, *d.counts) for d in two]
    assert [d.low for d in one] == list(range(shards)) and sum(d.counts for d in one).tolist() == counts.tolist()
    assert all(d.counts.sum() == min(8, total - 8 * d.low) and (d.counts >= 0).all() for d in one)


def test_mix_tells_its_documents(spark):
    rng = random.Random(5)
    texts = [" ".join([f"d{i}"] * rng.choice([1, 3, 40, 300])) for i in range(40)] + [None, "", "none " * 9, "again again"]
    ids = [*range(len(texts) - 2), None, 0]
    docs = documents(spark, texts, sources=[rng.choice(["a", "b"]) for _ in texts], ids=ids)
    mixed = mixing.mix_sources(docs)
    words_of = {f"d{i}": i for i in range(40)} | {"none": None, "again": 0}
    by_doc = Counter()
    for b in mixing.packed_blocks(docs, mixed).collect():
        own = Counter(words_of[w] for w in b["text"].split(" "))
        assert [tuple(x) for x in b["doc_ids"]] == sorted(own.items(), key=lambda x: (x[0] is None, x[0] or 0))
        by_doc.update(own)
    taken = Counter()
    for r in mixing.taken_words(mixed).collect():
        taken[r["doc_id"]] += r["taken"]
    assert by_doc == +taken


def test_language_on_held_out_texts(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "and", "ou"], "bb": ["sch", "ein", "ü", "ung"], "cc": ["eau", "que", "é", "ment"]}
    texts, langs = [], []
    for _ in range(400):
        lang = rng.choice(list(parts))
        texts.append(" ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))))
        langs.append(lang)
    texts += [None, "", "123 ...", "…", "ü", "\n"]
    langs += ["aa"] * 5 + [None]
    docs = documents(spark, texts, langs)
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()}
    import zlib
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    tested = [i for i in range(400) if held[i]]
    assert sum(got[i]["lang_pred"] == langs[i] for i in tested) >= 0.98 * len(tested)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (400, 401, 402, 403, 405)) and got[404]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.allclose(model.table, language.train(docs.repartition(3)).table), "training does not depend on partitions"
    nothing = language.train(documents(spark, []))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_gumbel_keeps_good_texts(spark):
    rng = random.Random(7)
    known = [f"word{i}" for i in range(300)]
    texts, bad = [], []
    for i in range(1500):
        own = [rng.choice(known) for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.2:
            own.insert(rng.randint(0, len(own)), rng.choice(["idiot", "Idiot,", "scum"]))
            bad.append(i)
        texts.append(" ".join(own))
    labels = spark.createDataFrame([(i, 1, int(i in set(bad))) for i in range(0, 1500, 2)] + [(0, 1, None), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(spark, [*texts, None, ""])
    got = {r["doc_id"]: r["kept"] for r in resampling.resample(docs, labels).collect()}
    assert not any(got[i] for i in bad) and all(got[i] for i in range(1500) if i not in set(bad)) and got[1500] and got[1501]
    kept = resampling.keep_like_target(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 1502 - len(bad)
    none = labels.limit(0)
    assert resampling.keep_like_target(docs, none).count() == 1502 and resampling.keep_like_target(docs.limit(0), none).count() == 0
    assert resampling.resample(docs, labels, k=100).filter("kept").count() == 100


def test_long_runs_of_a_word_go_and_triples_stay(spark):
    rng = random.Random(11)
    known = [f"word{i}" for i in range(300)]
    texts, junk = [], set()
    for i in range(1500):
        own = [rng.choice(known) for _ in range(rng.randint(5, 80))]
        if i % 10 == 0:
            own[rng.randint(0, len(own)):0] = [f"junk{i}"] * rng.randint(12, 60)
            junk.add(i)
        elif rng.random() < 0.2:
            own[rng.randint(0, len(own)):0] = ["very"] * 3
        texts.append(" ".join(own))
    # A run ends with its text: the last words of one text and the first of the next are no run.
    texts += [w for i in range(20) for w in (f"end{i} more " + "same " * 6, "same " * 6 + f"more begin{i}")]
    labels = spark.createDataFrame([(i, int(i not in junk), 0) for i in range(0, 1500, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in resampling.resample(documents(spark, texts), labels).collect()}
    assert not any(got[i] for i in junk) and all(got[i] for i in range(1500) if i not in junk)
    runs = [("space", 10)]
    frame = documents(spark, texts[1500:])
    counts, _, _ = resampling.count_models(frame, labels.limit(0), 1 << 12, tuple(runs))
    assert not counts.any()


def test_kth_largest(spark):
    values = [1.0, 5.0, 5.0, -2.0, 7.5, 7.5, 7.5, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values) + 1):
        assert resampling.kth_largest(frame, "v", k, gather=1, bins=2) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(frame, "v", 0) == float("inf")
