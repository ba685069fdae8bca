"""Tables that cut lineage: shuffle files and used tables go, results stay."""

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from caseloom import session


def folders(spark) -> set[str]:
    return {p.name for p in Path(urlparse(session.use_checkpoint_dir(spark)).path).glob("table-*")}


def test_used_tables_are_dropped_when_the_next_one_is_whole(spark):
    before = folders(spark)
    first = session.cut_lineage(spark.range(100).withColumn("k", F.col("id") % 7))
    kept = session.cut_lineage(spark.range(3))
    second = session.cut_lineage(first.groupBy("k").count(), first)
    assert len(folders(spark) - before) == 2
    assert second.agg(F.sum("count")).first()[0] == 100 and kept.count() == 3
    session.drop_tables(second, kept, kept, spark.range(1))
    assert folders(spark) == before


def test_a_failed_write_keeps_what_it_reads(spark):
    first = session.cut_lineage(spark.range(10))
    failing = first.select(F.raise_error(F.lit("no")).alias("x"))
    try:
        session.cut_lineage(failing, first)
    except Exception:
        pass
    assert first.count() == 10
    assert spark.conf.get(session._RELEASE) == "false"
    session.drop_tables(first)


def test_results_do_not_need_released_shuffles(spark):
    """A plan whose shuffle files were released is run anew by its next action."""
    grouped = spark.range(10_000).groupBy((F.col("id") % 13).alias("k")).count()
    written = session.cut_lineage(grouped)
    again = session.cut_lineage(grouped.join(grouped.withColumnRenamed("count", "n"), "k"))
    assert written.count() == 13 and again.filter("count = n").count() == 13
    assert grouped.count() == 13
    with session.shuffles_released(spark):
        assert grouped.agg(F.sum("count")).first()[0] == 10_000
    assert sorted(r["count"] for r in grouped.collect()) == sorted(r["count"] for r in written.collect())
    session.drop_tables(written, again)


def test_blocks_that_overlap_in_threads_restore_the_setting(spark):
    before = spark.conf.get(session._RELEASE, "false")
    first, second = session.shuffles_released(spark), session.shuffles_released(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(session._RELEASE) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(session._RELEASE) == before == "false"
