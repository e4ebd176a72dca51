import random

import pytest

from ledgerlight.llm import jaccard
from ledgerlight.operators import dedup


def brute(rows, threshold):
    words = {i: set(t.lower().split()) for i, t in rows}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(words):
        for j in sorted(words):
            if i < j and words[i] and words[j] and len(words[i] & words[j]) / len(words[i] | words[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in words}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(90):  # one hot group of near copies, chained at its edge
        words = set(vocabulary[:30])
        for _ in range(rng.randint(0, 5)):
            words.discard(rng.choice(vocabulary[:30]))
            words.add(rng.choice(vocabulary))
        out.append((i, " ".join(sorted(words))))
    out += [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 6)))) for i in range(90, 160)]
    return out + [(160, ""), (161, "  "), (162, out[0][1].upper())]


@pytest.mark.parametrize("threshold, small, rounds", [(0.9, 64, 8), (0.9, 3, 3), (0.8, 4, 2)])
def test_groups_equal_brute_force(spark, rows, threshold, small, rounds):
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {r.id: r.group_id for r in dedup.dedup_corpus(df, "id", "text", threshold, small=small, rounds=rounds).collect()}
    assert got == brute(rows, threshold)


@pytest.mark.parametrize("small, rounds", [(2, 0), (2, 1), (64, 0)])
def test_common_words_do_not_lose_pairs(spark, small, rounds):
    """Every word is in most sets, so all buckets are large and are split by a second word."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    made = []
    for i in range(120):
        words = set(rng.sample(vocabulary, 30)) if i % 3 or not made else set(made[rng.randrange(len(made))][1].split())
        if i % 3 == 0 and rng.random() < 0.8:
            words ^= {rng.choice(vocabulary)}
        made.append((i, " ".join(sorted(words))))
    df = spark.createDataFrame(made, "id long, text string").repartition(3)
    got = {r.id: r for r in dedup.near_copies(df, "id", "text", small=small, rounds=rounds).collect()}
    want = brute(made, 0.9)
    assert {i: r.group_id for i, r in got.items()} == want
    sets = {i: set(t.split()) for i, t in made}
    assert all(abs(r.similarity - len(sets[i] & sets[r.group_id]) / len(sets[i] | sets[r.group_id])) < 1e-9 for i, r in got.items())


def test_a_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "a long, b long, similarity double")
    groups = {r.id: r.group_id for r in dedup.connected_groups(edges).collect()}
    assert groups == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_entries_of_a_set_do_not_grow_with_the_corpus(spark, monkeypatch):
    """Every word is in most sets: a bucket by words would hold nearly all of them, however many they are."""
    made, real = [], jaccard.entries

    def entries(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(jaccard, "entries", entries)
    rng, vocabulary = random.Random(9), [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(rng.sample(vocabulary, 70))) for i in range(160)]
    counts = []
    for n in (80, 160):
        df = spark.createDataFrame(rows[:n], "id long, text string")
        assert {r.id: r.group_id for r in dedup.dedup_corpus(df, "id", "text").collect()} == brute(rows[:n], 0.9)
        counts.append(made[-1].count())
    assert counts[1] <= 2.2 * counts[0]


def test_a_repeated_id_hides_no_link(spark):
    one, other = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(one)), (2, " ".join(other)), (2, " ".join([*one[1:], "x"]))]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r.id, r.group_id) for r in dedup.dedup_corpus(df, "id", "text").collect()} == {(1, 1), (2, 1)}
