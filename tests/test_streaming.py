from datetime import datetime, timedelta

from corpusflow.streaming import leases

T0 = datetime(2025, 1, 1)


def test_exclusive_leases(spark, tmp_path):
    rows = [("u", 0, "a", "acquire"), ("u", 10, "b", "acquire"), ("u", 20, "a", "renew"), ("u", 30, "a", "release"), ("u", 40, "b", "acquire"), ("u", 5000, "a", "acquire"), ("v", 0, "a", "renew"), ("v", 1, "a", "release")]
    df = spark.createDataFrame([(u, T0 + timedelta(seconds=s), w, a) for u, s, w, a in rows], "unit string, at timestamp, session string, action string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = sorted((r.unit, r.at, r.session, r.outcome) for r in leases.replay(spark, leases.exclusive_leases(stream), "leases").collect())
    assert [g[3] for g in got] == ["granted", "conflict", "renewed", "released", "granted", "granted", "missing", "missing"]


def test_spans_in_batch(spark):
    df = spark.createDataFrame([("u", T0), ("u", T0 + timedelta(minutes=50)), ("u", T0 + timedelta(minutes=170))], "u string, at timestamp")
    assert sorted((r.claimed_at, r.n_renewals) for r in leases.lease_spans(df, "at", "u").collect()) == [(T0, 1), (T0 + timedelta(minutes=170), 0)]
