"""Small corpora with every awkward case, and plain forms of what operators compute."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
                     T.StructField("part", T.LongType()), T.StructField("node", T.StringType()),
                     *[T.StructField(name, T.LongType()) for name in ("mark", "finger", "row", "gone", "hash", "_id", "x.y")]])


def documents(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else "a", None if t is None else len(t), "x", 7, "y", *range(7))
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=1, n=60, words=40, vocabulary=400):
    """Texts with copies, near copies, shared passages, repeated words, odd blanks, long words and nothing at all."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdeXYZéñ") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(known) for _ in range(18))
    texts = []
    for _ in range(n):
        own = [rng.choice(known) for _ in range(rng.randint(1, 2 * words))]
        if rng.random() < 0.3:
            own.insert(rng.randint(0, len(own)), passage)
        if rng.random() < 0.2:
            own += [rng.choice(known)] * 30
        body = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", ", "]) for w in own)
        texts.append(body)
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            copy = body.split(" ")
            if rng.random() < 0.6 and len(copy) > 1:
                copy[rng.randrange(len(copy))] = rng.choice(known)
            texts.append(" ".join(copy))
    return [*texts, None, "", " ", "\n", "a", "A b", "a B", " ", "…", "x" * 5000, " ".join(known * 3), "\n".join(["same line"] * 40)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text, fold=True):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text) if fold else text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
