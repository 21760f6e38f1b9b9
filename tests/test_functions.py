from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotwise.functions.timeparts import (
    as_nominal, fill_template, format_nominal, from_millis, nominal_literal, parse_nominal, parts_upto,
    render_template, slot_time, time_parts, to_millis,
)
from slotwise.functions.uris import parse_view_uri, split_uri
from slotwise.plans.settings import input_settings, job_settings, output_settings, with_prefix

TEMPLATE = "view:hive:shop/visits?year=${YEAR}&month=${MONTH}&day=${DAY}&hour=${HOUR}&minute=${MINUTE}"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_time_parts(spark):
    ts = nominal_literal("2015-05-07T09:04:59.999")
    assert tuple(one(spark, *time_parts(ts).values())) == (2015, 5, 7, 9, 4)
    assert list(time_parts(ts, "day")) == ["year", "month", "day"]
    with pytest.raises(ValueError):
        parts_upto("second")


def test_render_template(spark):
    ts = nominal_literal("2015-05-12T18:03Z")
    plain, padded, column = one(
        spark, render_template(TEMPLATE, ts), render_template(TEMPLATE, ts, padded=True),
        render_template(F.lit(TEMPLATE), ts))
    assert plain == "view:hive:shop/visits?year=2015&month=5&day=12&hour=18&minute=3"
    assert padded == "view:hive:shop/visits?year=2015&month=05&day=12&hour=18&minute=03"
    assert column == plain == fill_template(TEMPLATE, as_nominal("2015-05-12T18:03Z"))
    assert one(spark, render_template("no holes", ts))[0] == "no holes"


def test_nominal_text(spark):
    text, back = one(
        spark, format_nominal(nominal_literal("2015-05-12T18:00:59")), parse_nominal(F.lit("2015-05-12T18:00Z")))
    assert (text, back) == ("2015-05-12T18:00Z", dt.datetime(2015, 5, 12, 18))
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        one(spark, parse_nominal(F.lit("2015-05-12 18:00")))
    assert as_nominal("2015-05-12T20:00+02:00") == dt.datetime(2015, 5, 12, 18)


def test_nominal_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = one(spark, to_millis(nominal_literal("2015-05-12T18:00Z")).alias("m"),
                  from_millis(F.lit(1431453600000)).alias("t"), F.hour(nominal_literal("2015-05-12T18:00Z")).alias("h"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (1431453600000, dt.datetime(2015, 5, 12, 18), 18)


def test_millis(spark):
    row = one(spark, to_millis(nominal_literal("1969-12-31T23:59:59.999999")), from_millis(F.lit(-1)))
    assert tuple(row) == (-1, dt.datetime(1969, 12, 31, 23, 59, 59, 999000))


def test_slot_time_fills_missing_parts(spark):
    row = one(spark, slot_time({"year": F.lit(2015), "month": F.lit(5)}), slot_time({"year": F.lit(2015), "day": F.lit(9)}))
    assert tuple(row) == (dt.datetime(2015, 5, 1), dt.datetime(2015, 1, 9))


URIS = [
    ("view:hive:shop/visits?year=2015&month=5", ("view", "hive", None, "shop/visits", {"year": "2015", "month": "5"})),
    ("view:hive://catalog.local:9083/shop/visits?year=2015",
     ("view", "hive", "catalog.local:9083", "shop/visits", {"year": "2015"})),
    ("view:hdfs:///lake/settings", ("view", "hdfs", None, "/lake/settings", {})),
    ("dataset:hive:shop/visits", ("dataset", "hive", None, "shop/visits", {})),
    ("view:file:/x?a=1&b=2&a=3&a=", ("view", "file", None, "/x", {"b": "2", "a": ""})),
    ("dataset:file:/tmp/x?a=b%20c", ("dataset", "file", None, "/tmp/x", {"a": "b%20c"})),
]


def test_parse_view_uri(spark):
    df = spark.createDataFrame([(i, uri) for i, (uri, _) in enumerate(URIS)], "n int, uri string")
    rows = df.orderBy("n").select(
        parse_view_uri(F.col("uri")).alias("u"), parse_view_uri(F.col("uri"), True).alias("d")).collect()
    assert [tuple(r.u) for r in rows] == [wanted for _, wanted in URIS]
    assert rows[-1].d.constraints == {"a": "b c"}


def test_split_uri():
    for uri, (kind, store, authority, path, constraints) in URIS[:-1]:
        assert split_uri(uri) == (kind, store, authority or "", path, constraints)
    assert split_uri(URIS[-1][0]).constraints == {"a": "b c"}
    assert split_uri("view:hive://catalog.local:9083/shop/visits?year=2015").table == "`shop`.`visits`"
    assert split_uri("dataset:hdfs:///tmp/x").location == "hdfs:///tmp/x"
    assert split_uri("dataset:file:/tmp/x").location == "file:///tmp/x"
    assert split_uri("dataset:s3a://bucket/x").location == "s3a://bucket/x"
    for bad in ("shop/visits", "table:hive:shop", "view:hive:"):
        with pytest.raises(ValueError):
            split_uri(bad)


def test_settings():
    app = {
        "app.key": "app", "shared": "app", "hadoop.x": "1",
        "job.report.shared": "job", "job.report.input.users.only": "in", "job.report.output.out.only": "out",
        "job.other.shared": "no",
    }
    of_job = job_settings(app, "report", {"shared": "default", "extra": "default"})
    assert of_job == {"app.key": "app", "shared": "job", "hadoop.x": "1", "extra": "default",
                      "input.users.only": "in", "output.out.only": "out"}
    general = {"app.key": "app", "shared": "job", "hadoop.x": "1", "extra": "default"}
    assert input_settings(of_job, "users") == {**general, "only": "in"}
    assert output_settings(of_job, "out") == {**general, "only": "out"}
    assert with_prefix(of_job, "hadoop.") == {"x": "1"}
