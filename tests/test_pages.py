import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import audit, pages

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """One user with half of all rows, many rows at one time, some without a time."""
    rng = random.Random(6)
    rows = [(i, 1 if rng.random() < 0.5 else rng.randint(2, 30), None if i % 97 == 0 else START + dt.timedelta(minutes=rng.randint(0, 400)), i % 5 == 0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, user_id int, created_at timestamp_ntz, bad boolean").repartition(4)
    return df, pages.write_pages(df, str(tmp_path_factory.mktemp("pages") / "t"), file_rows=150)


def ids(df):
    return [r.id for r in df.collect()]


def walk(made, owner, limit, where=None):
    out, cursor = [], None
    while True:
        rows = pages.page_before(made, owner, limit, cursor, where).collect()
        if not rows:
            return out
        out.append([r.id for r in rows])
        cursor = (rows[-1].created_at, rows[-1].id)


@pytest.mark.parametrize("owner,limit", [(1, 400), (7, 20), (99, 5)])
def test_pages_equal_offsets(table, owner, limit):
    df, made = table
    found = walk(made, owner, limit)
    for n, page in enumerate(found):
        assert page == ids(audit.history(df, owner, limit, n * limit))
    assert sum(map(len, found)) == df.where(F.col("user_id") == owner).count()


def test_a_page_reads_few_files(table):
    df, made = table
    everything = len(set(r.file for r in made.index().collect()))
    first = pages.page_before(made, 1, 20)
    rows = first.collect()
    later = pages.page_before(made, 1, 20, (rows[-1].created_at, rows[-1].id))
    assert everything >= 15 and len(first.inputFiles()) <= 2 and len(later.inputFiles()) <= 2
    assert len(pages.page_before(made, 12, 20).inputFiles()) <= 3
    assert pages.page_before(made, 1, 20, (None, 0)).count() == 0  # nothing comes after the first row without a time


def test_pages_under_a_condition(table):
    df, made = table
    wanted = ids(df.where("user_id = 1 AND bad").orderBy(F.desc("created_at"), F.desc("id")))
    assert sum(walk(made, 1, 100, F.col("bad")), []) == wanted
    assert len(pages.page_before(made, 1, 5, where=F.col("bad")).inputFiles()) <= 2
    assert ids(pages.page_before(made, 1, 5, where=F.col("id") < 0)) == []


def test_no_rows(spark, tmp_path):
    made = pages.write_pages(spark.createDataFrame([], "id long, user_id int, created_at timestamp_ntz"), str(tmp_path / "t"))
    assert pages.page_before(made, 1).count() == 0
