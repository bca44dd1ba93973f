"""Outer joins of streams: equal to the batch joins at the end of both, over a restart too."""

from datetime import datetime, timedelta

from newsloom.streaming import joins

START = datetime(2024, 1, 1)
A, T = "id long, url_key string, ts timestamp", "url_key string, attempts long, ts timestamp"


def at(days):
    return START + timedelta(days=days)


def land(spark, rows, schema, folder):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def end(spark, schema, folder):
    joins.closing_row(spark.read.schema(schema).parquet(folder)).write.mode("append").parquet(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_left_join_over_a_restart(spark, tmp_path):
    a, t, out, state = (str(tmp_path / x) for x in ("a", "t", "out", "state"))
    articles = land(spark, [(1, "x", at(1)), (2, "y", at(2)), (3, None, at(2)), (6, "far", at(1))], A, a)
    attempts = land(spark, [("x", 3, at(1.5)), ("z", 4, at(2))], T, t)
    joined = lambda: joins.attempts_of_articles(articles, attempts)
    first = rows(joins.run_out(joined(), out, state))
    assert first == [(1, 3)]  # the others may still come
    land(spark, [(4, "z", at(5)), (5, "w", at(6))], A, a)
    land(spark, [("y", 7, at(8)), ("far", 9, at(60))], T, t)
    end(spark, A, a)
    end(spark, T, t)
    assert rows(joins.run_out(joined(), out, state)) == [(1, 3), (2, 7), (3, 0), (4, 4), (5, 0), (6, 0)]  # 59 days are past the bound


def test_open_attempts(spark, tmp_path):
    d, t, out, state = (str(tmp_path / x) for x in ("d", "t", "out", "state"))
    attempts = land(spark, [("x", 1, at(1)), ("y", 2, at(2)), ("z", 3, at(3))], T, t)
    done = land(spark, [("x", at(4)), ("x", at(5))], "url_key string, ts timestamp", d)
    assert rows(joins.run_out(joins.attempts_not_done(attempts, done), out, state)) == []
    land(spark, [("z", at(20))], "url_key string, ts timestamp", d)
    end(spark, "url_key string, ts timestamp", d)
    end(spark, T, t)
    assert rows(joins.run_out(joins.attempts_not_done(attempts, done), out, state)) == [("y", 2)]


def test_streams_without_rows(spark, tmp_path):
    a, t = str(tmp_path / "a"), str(tmp_path / "t")
    articles, attempts = land(spark, [], A, a), land(spark, [("x", 1, at(1))], T, t)
    end(spark, A, a)
    end(spark, T, t)
    assert rows(joins.run_out(joins.attempts_of_articles(articles, attempts), str(tmp_path / "o"), str(tmp_path / "s"))) == []
