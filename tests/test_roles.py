import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tallymart.plans.roles import SQL, role

NAMES = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def test_order_items_by_the_columns_that_settle_it(spark, tmp_path):
    """One row a key as the SQL says, from the columns that it returns and their order alone."""
    day = dt.datetime(2020, 1, 1)
    rows = [
        (1, 5, 2, 1, 9.0, 10.5, 0.1, 0.2, "A", "F", day),
        (1, 5, 2, 1, 1.0, 10.5, 0.1, 0.0, "R", "O", day),  # the same item, other columns
        (1, 5, 2, 1, 1.0, 10.5, 0.05, 0.0, "R", "O", day),
        (1, None, 1, 2, 1.0, 1.0, 0.0, 0.0, "R", "O", day),
        (1, 7, None, 2, 1.0, 2.0, 0.0, 0.0, "R", "O", day),
        (1, 7, 3, 2, 1.0, 3.0, 0.0, 0.0, "R", "O", day),
        (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "O", day),
        (None, 1, 1, 1, 1.0, 0.5, 0.0, 0.0, "R", "O", day),
    ]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string(), pa.timestamp("us")]
    pq.write_table(pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(NAMES, kinds))}), tmp_path / "lineitem.parquet")
    got = role(spark, str(tmp_path), "order_items")
    want = duckdb.sql(SQL["order_items"].format(lineitem=f"'{tmp_path}/lineitem.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(c in plan for c in ("l_tax", "l_quantity", "l_returnflag", "l_linestatus"))
