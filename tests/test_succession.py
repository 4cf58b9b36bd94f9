from datetime import date

from bourseflow.operators.succession import newest_ids, under_newest_id


def links(spark, rows):
    return spark.createDataFrame(rows, "old_id long, new_id long")


def test_chains_circles_and_forks(spark):
    chain = [(k, k + 1) for k in range(1, 300)]
    rows = chain + chain[:5] + [(1001, 1002), (1002, 1003), (1003, 1001), (1000, 1001), (2001, 2002), (2002, 2003), (2002, 2004), (3000, 3000), (None, 1), (5, None)]
    got = {r.id: (r.head, r.steps, r.problem) for r in newest_ids(links(spark, rows)).collect()}
    want = {k: (300, 300 - k, None) for k in range(1, 300)}
    want |= {k: (k, 0, "cycle") for k in (1000, 1001, 1002, 1003)} | {2001: (2002, 1, None), 2002: (2002, 0, "fork")}
    assert got == want
    assert newest_ids(links(spark, rows[:0])).count() == 0


def test_each_year_once_from_the_nearest_id(spark):
    rows = [(1, date(2001, 12, 31), 1), (1, date(2002, 12, 31), 2), (2, date(2002, 12, 31), 3), (3, date(2003, 6, 30), 4), (3, date(2003, 12, 31), 5),
            (2, date(2003, 12, 31), 6), (9, date(2001, 12, 31), 7)]
    table = spark.createDataFrame(rows, "stock_id long, period_end date, revenue long")
    got = under_newest_id(table, newest_ids(links(spark, [(1, 2), (2, 3)])), ["revenue"]).collect()
    assert sorted((r.stock_id, r.fiscal_year, r.from_id, r.steps, r.others, r.revenue) for r in got) == [
        (3, 2001, 1, 2, 0, 1), (3, 2002, 2, 1, 1, 3), (3, 2003, 3, 0, 1, 5), (9, 2001, 9, 0, 0, 7)]
