"""The ingest cycle as a batch and as a stream."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.files import delete, exists
from broadsheet.functions.urls import url_bucket
from broadsheet.operators import links as L
from broadsheet.operators.rules import with_rules
from broadsheet.plans import ingest as I
from broadsheet.plans import reader as R
from broadsheet.schemas import ARCHIVE
from broadsheet.sources import archive as A
from broadsheet.streaming.ingest import start_ingest


def landed(spark, sf_dir):
    title = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html", title.alias("title"))


def content(rows):
    names = [n for n in ARCHIVE.fieldNames() if n != "id"]
    return sorted(map(str, rows.select(names).collect()))


def test_a_batch_can_be_repeated(spark, sf_dir, tmp_path):
    path = str(tmp_path / "archive")
    pages = landed(spark, sf_dir)
    I.ingest_batch(pages, path)
    first = content(A.read_archive(spark, path))
    assert len(first) == pages.count()
    I.ingest_batch(pages.union(pages), path)
    assert content(A.read_archive(spark, path)) == first


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    pages = landed(spark, sf_dir)
    I.ingest_batch(pages, str(tmp_path / "batch"))
    # Names with blanks, percent signs and wildcards, which a path to read has to escape.
    pages.repartition(3).write.parquet(str(tmp_path / "landed [1] 50% {a}"))
    for attempt in range(2):
        query = start_ingest(
            spark,
            str(tmp_path / "landed \\[1\\] 50% \\{a\\}"),
            str(tmp_path / "stream"),
            str(tmp_path / f"checkpoint{attempt}"),
            every=None,
            files_per_batch=1,
        )
        assert query.awaitTermination(300)
    assert content(A.read_archive(spark, str(tmp_path / "stream"))) == content(
        A.read_archive(spark, str(tmp_path / "batch"))
    )


def test_gate(spark):
    rows = spark.createDataFrame(
        [("u1", 5), ("u2", 5), ("u3", 0), (" ", 5), (None, 5)], "url string, text_length long"
    )
    archive = spark.createDataFrame([("u2",), ("u2",)], "url string")
    got = sorted(str(r.reject) for r in I.gate_reasons(rows, archive).collect())
    assert got == ["None", "blank url", "blank url", "empty", "known"]


def test_the_first_page_with_text_wins(spark):
    html = "<article>{}</article>"
    pages = spark.createDataFrame(
        [(3, "u", html.format("late")), (1, "u", html.format("")), (2, "u", html.format("early")), (4, "v", None)],
        "page_id long, url string, html string",
    )
    nothing = spark.createDataFrame([], ARCHIVE)
    assert [r.content for r in I.new_articles(pages, nothing).collect()] == ["early"]


def test_extraction_is_not_done_twice(spark, sf_dir):
    """The gate on text length must not sit below the columns it looks at."""
    rows = I.archive_rows(landed(spark, sf_dir), spark.createDataFrame([], ARCHIVE))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if " Filter " in line]
    assert filters and not any("regexp_replace" in line for line in filters)


def test_page_links_do_not_shuffle(spark, sf_dir):
    rows = I.page_links(landed(spark, sf_dir))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan
    assert not any("split(" in line for line in plan.split("\n") if " Filter " in line)


def scans_of(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "FileScan" in line]


def test_known_urls_read_one_column(spark, sf_dir, tmp_path):
    path = str(tmp_path / "archive")
    I.ingest_batch(landed(spark, sf_dir), path)
    pages = landed(spark, sf_dir)
    for known in (A.read_archive(spark, path), A.read_known(spark, path)):
        for fresh in (None, L.fresh_urls(pages, known)):
            scans = scans_of(I.archive_rows(pages, known, fresh=fresh))
            # One scan has the pages; known URLs and the batch's URLs are read for that column only.
            assert sum("html" in line for line in scans) == 1
            assert sum("ReadSchema: struct<url:string>" in line for line in scans) == len(scans) - 1 > 1


def test_html_is_not_shuffled(spark, sf_dir, tmp_path):
    pages = landed(spark, sf_dir)
    fresh = L.fresh_urls(pages, A.read_known(spark, str(tmp_path / "none")))
    rows = I.archive_rows(pages, None, fresh=F.broadcast(fresh))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    joined = plan[plan.index("BroadcastHashJoin [url"):]
    assert "LeftSemi, BuildRight" in joined.split("\n")[0] and above


@pytest.mark.parametrize("digits", [1, 3])
def test_a_batch_opens_only_its_own_buckets(spark, sf_dir, tmp_path, digits):
    path = str(tmp_path / "archive")
    I.ingest_batch(landed(spark, sf_dir), path)
    if digits > 1:
        A.compact_known(spark, path, digits)
    one = landed(spark, sf_dir).filter("page_id = 3").limit(1)
    bucket = one.select(url_bucket(F.col("url"), digits)).first()[0]
    known = A.read_known(spark, path)
    plan = L.known_among(known, one)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "url_bucket" in line)
    assert "array_contains(" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # All other buckets are unreadable now.
    others = [f for f in Path(A.known_path(path)).rglob("*.parquet") if f"url_bucket={bucket}/" not in str(f)]
    assert len(others) > 10
    for file in others:
        file.write_bytes(b"not a table")
        file.with_name(f".{file.name}.crc").unlink()
    assert L.known_among(known, one).count() == 1
    before = content(A.read_archive(spark, path))
    I.ingest_batch(one, path)
    assert content(A.read_archive(spark, path)) == before


def test_an_append_that_was_cut_short(spark, sf_dir, tmp_path, monkeypatch):
    """Rows without keys are found again by the mark, so a replayed batch adds nothing."""
    path, pages = str(tmp_path / "archive"), landed(spark, sf_dir)
    I.ingest_batch(pages.filter("page_id < 10"), path)

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(A, "append_known", lost)
        try:
            I.ingest_batch(pages, path)
        except RuntimeError:
            pass
    archived, known = A.read_archive(spark, path), A.read_known(spark, path)
    assert archived.count() == pages.count() and known.count() == 10
    I.ingest_batch(pages, path)
    assert A.read_archive(spark, path).count() == A.read_known(spark, path).count() == pages.count()
    assert not exists(spark, A.unfinished_path(path))


def test_key_table_is_made_kept_and_cleared(spark, sf_dir, tmp_path):
    path, pages = str(tmp_path / "archive"), landed(spark, sf_dir)
    for part in range(3):
        I.ingest_batch(pages.filter(F.col("page_id") % 3 == part), path)
    urls = sorted(r.url for r in A.read_known(spark, path).collect())
    assert urls == sorted(r.url for r in pages.select("url").collect())
    for digits in (1, 3, 2):
        A.compact_known(spark, path, digits)
        assert sorted(r.url for r in A.read_known(spark, path).collect()) == urls
        I.ingest_batch(pages, path)
    assert A.read_archive(spark, path).count() == len(urls)
    # An archive from before there were keys.
    delete(spark, A.known_path(path))
    I.ingest_batch(pages, path)
    assert A.read_archive(spark, path).count() == len(urls) == A.read_known(spark, path).count()
    A.truncate_archive(spark, path)
    assert A.read_known(spark, path).count() == 0
    I.ingest_batch(pages, path)
    assert A.read_archive(spark, path).count() == len(urls)


def spoil_other_buckets(path, rows):
    """Make every bucket unreadable but those the rows lie in; how many are left."""
    places = {f"publish_date={r.publish_date}/id_bucket={r.id_bucket}" for r in rows}
    for file in Path(path).rglob("*.parquet"):
        if not any(place in str(file) for place in places):
            file.write_bytes(b"not a table")
            file.with_name(f".{file.name}.crc").unlink()
    return len(places)


def test_reader_fetches_only_the_picked_days(spark, tmp_path):
    path = str(tmp_path / "archive")
    day = F.make_date(F.lit(2024), F.lit(1), (1 + F.col("id") % 28).cast("int"))
    rows = spark.range(280).select(
        "id",
        F.lit("t").alias("title"),
        F.concat(F.lit("u"), "id").alias("url"),
        F.lit(1).cast("long").alias("text_length"),
        F.lit(0).cast("long").alias("image_count"),
        F.when(F.col("id") % 10 > 0, day.cast("timestamp")).alias("publish_time"),
        F.lit("p").alias("publisher"),
        F.lit("c").alias("content"),
        F.lit(0).alias("category"),
    )
    A.append_archive(rows, path)
    archive = A.read_archive(spark, path)
    assert archive.count() == 280
    opening = R.opening(archive)
    assert {str(r.publish_date) for r in opening.collect()} <= {"2024-01-28", "2024-01-27"}
    plan = opening._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "content" in line and "FileScan" in line]
    assert wide and all("array_contains(" in line.split("PartitionFilters")[1] for line in wide)

    now = F.lit("2024-01-28 12:00:00").cast("timestamp")
    batch = R.next_batch(archive, opening, now, 3)
    assert batch.count() == 5
    history = R.extend_history(opening, batch)
    assert history.select("id").distinct().count() == 15
    assert R.previous_one(archive, history, 3).count() == 1
    assert all(r.spoken.startswith("t。作者：p。") for r in R.spoken(batch, now).collect())

    A.truncate_archive(spark, path)
    assert A.read_archive(spark, path).count() == 0
    A.append_archive(rows, path)
    assert A.read_archive(spark, path).count() == 280

    # The picks are made; the rows come from their buckets alone.
    seen = spark.createDataFrame([(i,) for i in range(40)], "id long")
    batch = R.next_batch(A.read_archive(spark, path), seen, now, 4)
    want = batch.collect()
    assert spoil_other_buckets(path, want) <= 5 and batch.collect() == want



def test_rules_are_broadcast(spark, sf_dir):
    plan = with_rules(landed(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
