from datetime import datetime
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import selection as S

NOW = datetime(2024, 1, 30, 12)
ROWS = "id long, publish_time timestamp"


def key(seed, i):
    return md5(f"{seed}:{i}".encode()).hexdigest(), i


@pytest.fixture(scope="module")
def archive(spark):
    key = F.col("id").cast("int")
    day = F.make_timestamp(F.lit(2024), F.lit(1), 1 + key % 29, key % 24, F.lit(0), F.lit(0))
    return spark.range(0, 500, 1, 2).select("id", F.when(key % 11 != 0, day).alias("publish_time"))


OLD = {}


def old_ids(archive, days):
    """Ids of rows at least so old, in id order."""
    if "rows" not in OLD:
        OLD["rows"] = archive.orderBy("id").collect()
    return [
        r.id for r in OLD["rows"]
        if r.publish_time and (NOW - r.publish_time).total_seconds() >= days * 86400
    ]


def ids(rows):
    return [r.id for r in rows.collect()]


def test_latest_puts_undated_rows_last(archive):
    rows = S.latest(archive, 500).collect()
    assert all(r.publish_time is None for r in rows[-46:])
    times = [r.publish_time for r in rows[:-46]]
    assert times == sorted(times, reverse=True)


def test_random_one_guards_on_the_whole_archive(spark, archive):
    single = spark.createDataFrame([(1, NOW)], ROWS)
    nobody = spark.createDataFrame([], "id long")
    assert ids(S.random_one_unseen(single, nobody, 1)) == []
    both = spark.createDataFrame([(1, NOW), (2, NOW)], ROWS)
    assert ids(S.random_one_unseen(both, both.filter("id = 1").select("id"), 1)) == [2]
    assert ids(S.random_one_unseen(both, both.select("id"), 1)) == []
    everyone = archive.filter("id <> 77").select("id")
    assert ids(S.random_one_unseen(archive, everyone, 1)) == [77]


def expected_batch(archive, seen, seed, days, n):
    old = [i for i in old_ids(archive, days) if i not in seen]
    return sorted(old, key=lambda i: key(seed, i))[:n] if len(old) >= n > 0 else []


@pytest.mark.parametrize("n,days", [(10, 7), (3, 0), (3, -5), (460, 7), (0, 7), (-1, 7)])
def test_random_batch(spark, archive, n, days):
    seen = set(range(0, 500, 3))
    history = spark.createDataFrame([(i,) for i in seen], "id long")
    got = ids(S.random_batch_unseen(archive, history, NOW, 5, days, n))
    assert sorted(got) == sorted(expected_batch(archive, seen, 5, max(0, days), n))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_batches_of_many_readers(spark, archive, monkeypatch, chunk):
    """Readers who saw nothing old, everything, all but a few, and the first part of the order."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    order = sorted(old_ids(archive, 7), key=lambda i: key(9, i))
    pasts = {
        "new": [0],
        "all": list(range(500)),
        "but six": order[:-6],
        "but five": order[5:],
        "but four": order[4:],
        "first": order[:50],
        "mixed": order[3:40:2] + order[60:64],
        "hot": order[: len(order) // 2],
    }
    history = spark.createDataFrame([(r, i) for r, past in pasts.items() for i in past], "reader string, id long")
    got = {}
    for row in S.random_batch_per_reader(archive, history, NOW, 9, 7, 5).orderBy("pick").collect():
        got.setdefault(row.reader, []).append(row.id)
    want = {r: expected_batch(archive, set(past), 9, 7, 5) for r, past in pasts.items()}
    assert got == {r: b for r, b in want.items() if b}


@pytest.mark.parametrize("n", [1, 4, 5, 137, 1000])
def test_split_is_exact_and_seeded(spark, n):
    rows = spark.range(n).repartition(3)
    got = {r.id: r.split for r in S.split_exact(rows, 42).collect()}
    order = sorted(range(n), key=lambda i: key(42, i))
    cut = n - int(n * 0.2)
    assert got == {**dict.fromkeys(order[:cut], "train"), **dict.fromkeys(order[cut:], "valid")}
    if n > 100:
        other = {r.id: r.split for r in S.split_exact(rows, 43).collect()}
        assert other != got


def test_split_of_nothing(spark):
    assert S.split_exact(spark.range(0), 1).count() == 0


def test_places_are_the_seeded_order(spark):
    rows = S.with_place(spark.range(700), "s").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 701))
    assert [r.id for r in rows] == sorted(range(700), key=lambda i: key("s", i))


def test_history_keys_on_url_where_ids_collide(spark):
    archive = spark.createDataFrame([(1, "a"), (1, "b")], "id long, url string")
    assert [r.url for r in S.unseen(archive, archive.filter("url = 'a'")).collect()] == ["b"]
    assert S.unseen(archive, archive.select("id").limit(1)).count() == 0


def test_no_plan_pairs_rows(spark, archive):
    history = archive.select("id")
    frames = [
        S.random_one_unseen(archive, history, 1),
        S.random_batch_unseen(archive, history, NOW, 1),
        S.split_exact(archive, 1),
        S.random_batch_per_reader(archive, history.withColumn("reader", F.col("id") % 3), NOW, 1),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_one_article_read_by_everybody(spark, archive, tmp_path):
    """The article is a hot key of the history, and the first places are hot for all readers."""
    order = sorted(old_ids(archive, 7), key=lambda i: key(9, i))
    readers = spark.range(4_000).select(F.concat(F.lit("r"), "id").alias("reader"))
    history = readers.withColumn("id", F.lit(order[1]).cast("long"))
    history = history.unionByName(readers.filter("reader = 'r5'").withColumn("id", F.lit(order[0]).cast("long")))
    path = str(tmp_path / "archive")
    archive.write.parquet(path)
    rows = S.random_batch_per_reader(spark.read.parquet(path), history, NOW, 9, 7, 3)
    # The archive was read to make the order; the batches come from the order that was kept.
    assert "publish_time" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.reader, r.pick): r.id for r in rows.collect()}
    assert len(got) == 12_000
    usual = [order[0], order[2], order[3]]
    for reader in ("r0", "r77", "r3999"):
        assert [got[reader, k] for k in (1, 2, 3)] == usual
    assert [got["r5", k] for k in (1, 2, 3)] == order[2:5]
