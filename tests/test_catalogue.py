from collections import Counter

import duckdb
import pytest
from conftest import SF

from corvane.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, same, name):
    same(catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df())


def test_guarded_search_is_within_the_open_one(spark):
    q = catalogue.queries()
    guarded = {(r.src, r.dst) for r in q["callers_bfs_guarded"](spark, SF).collect()}
    assert guarded <= {(r.src, r.dst) for r in catalogue.edges_of(spark, SF).collect()}


def test_guarded_search_reads_all_edges(spark):
    sf = "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{sf}/orders.parquet").toPandas()
    edges = set(zip(orders.o_custkey, orders.o_orderkey // 10, strict=True))
    assert len(edges) > 10_000
    callers = Counter(d for _, d in edges)
    expected, frontier, seen = set(), {7}, {7}
    for hop in range(1, 5):
        found = {(hop, s, d) for s, d in edges if d in frontier}
        expected |= found
        frontier = set(sorted(n for n in {s for _, s, _ in found} - seen if callers[n] < 12)[:5])
        seen |= frontier
    assert sorted(tuple(r) for r in catalogue.queries()["callers_bfs_guarded"](spark, sf).collect()) == sorted(expected)


def test_pages_join_to_the_whole(spark):
    from pyspark.sql import functions as F

    from corvane.operators import search

    found = search.literal(catalogue.lines_of(spark, SF), "the")
    order = [F.col("path"), F.col("line")]
    whole = [tuple(r) for r in search.paged(found, order, 30).collect()]
    assert whole == [tuple(r) for k in (0, 10, 20) for r in search.paged(found, order, 10, k).collect()]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])  # the second has no 2024-03-10 02:00 to 03:00
@pytest.mark.parametrize("last", ["12:00:00.2", "12:00:00.5", "12:00:01.5", "12:00:01.8"])
def test_recency_takes_seconds_as_its_sql(spark, same, tmp_path, zone, last):
    """Times with parts of a second round to the nearest second, halves to the even one; none is old."""
    duck = duckdb.connect()
    duck.sql(f"""create table events as select row_number() over () as event_id, timestamp '2024-03-20 {last}' - to_seconds(age) + to_microseconds(us) as ts
        from (values (1), (3600), (3601), (86400), (86401), (604800), (604801), (2592000), (2592001), (2595000)) a(age), (values (0), (-300000), (-500001), (-500000), (-499999), (-700000), (-999999)) f(us)""")
    duck.sql(f"insert into events values (0, timestamp '2024-03-20 {last}'), (-1, null)")
    duck.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        same(catalogue.queries()["recency_points"](spark, str(tmp_path)).toPandas(), duck.sql(catalogue.oracle_sql()["recency_points"]).df())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
