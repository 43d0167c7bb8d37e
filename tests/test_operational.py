"""Operational tables over Spark's own Derby driver."""

from __future__ import annotations

from datetime import date, timedelta

from martloom.sources import operational

URL = "jdbc:derby:memory:shop;create=true"
DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_tables_in_ranges_of_a_column(spark, tmp_path):
    day = date(2030, 1, 1)
    rows = [(i if i % 50 else None, "a" if i % 3 else "o'b", day + timedelta(days=i % 40), f"n{i}") for i in range(1, 401)]
    lines = spark.createDataFrame(rows, "id int, tenant_id string, day date, name string")
    upper = lines.toDF(*[c.upper() for c in lines.columns])  # Derby's names without quotes are in capitals
    for name, df in (("lines", upper), ("nothing", upper.limit(0))):
        df.write.mode("overwrite").option("createTableColumnTypes", "TENANT_ID VARCHAR(20)").jdbc(URL, name, properties=DRIVER)
    lower = lambda df: {tuple(r[c] for c in ("id", "tenant_id", "day", "name")) for r in df.toDF(*[c.lower() for c in df.columns]).collect()}
    for column in ("id", "day"):
        got = operational.read_table(spark, URL, "lines", column, 4, properties=DRIVER)
        sizes = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
        assert len(sizes) == 4 and sum(sizes) == 400 and min(sizes) >= 80
        assert lower(got) == set(rows)
    tables = {"lines": "id", "nothing": "id"}
    found = operational.read_database(spark, URL, 3, tables, tenant_id="o'b", properties=DRIVER)
    assert lower(found["lines"]) == {r for r in rows if r[1] == "o'b"} and found["lines"].rdd.getNumPartitions() == 3
    assert found["nothing"].count() == 0
    assert operational.read_table(spark, URL, "lines", None, 4, properties=DRIVER).count() == 400
    lines.write.parquet(str(tmp_path / "lines"))
    assert lower(operational.read_folder(spark, str(tmp_path), {"lines": None})["lines"]) == set(rows)
