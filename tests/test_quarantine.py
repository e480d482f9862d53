"""Dirty CSV files: every record in exactly one table."""

import datetime as dt

from tallymart.operators import checks
from tallymart.sources.quarantine import ingest_csv
from tallymart.specs import DatasetSpec

SPEC = DatasetSpec("people", {"id": "integer", "name": "string", "height": "numeric", "born": "datetime"})
LINES = """id,name,height,born
1,"Ann ""A"" Lee
of Ulm",1.7,2000-01-02
2,Bob,tall,2000-01-02
3,Cy,NA,never
4,Di
5,Ed,1.5,2000-01-02,more
,,,
6.0,"",1e2,2001-02-03 04:05:06
6.5,x,1,
"""


def test_each_record_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(LINES)
    (tmp_path / "in/b.csv").write_text("id,name,height,born\n7,Flo,,\n")
    (tmp_path / "in/c.csv").write_text("")
    got = ingest_csv(spark, f"{tmp_path}/in", SPEC, f"{tmp_path}/out")
    kept = {(r.id, r.name, r.height, r.born) for r in got.kept.collect()}
    assert kept == {(1, 'Ann "A" Lee\nof Ulm', 1.7, dt.datetime(2000, 1, 2)), (6, None, 100.0, dt.datetime(2001, 2, 3, 4, 5, 6)), (7, "Flo", None, None), (None, None, None, None)}
    rejected = {(r.file, r.record.split(",")[0], tuple(r.reasons)) for r in got.rejected.collect()}
    assert rejected == {("a.csv", "2", ("height: not a number",)), ("a.csv", "3", ("born: not a timestamp",)), ("a.csv", "4", ("wrong number of fields",)), ("a.csv", "5", ("wrong number of fields",)), ("a.csv", "6.5", ("id: not a whole number",))}
    assert (got.n_kept, got.n_rejected) == (4, 5)
    row = checks.finish(got.check()).first()
    assert (row.status, row.failed_count, row.failure_rate, row.severity) == ("FAIL", 5, 55.5556, "HIGH")


def test_outcomes_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LINES)
    got = ingest_csv(spark, f"{tmp_path}/a.csv", SPEC, f"{tmp_path}/out")
    assert got.kept.select("id").count() == got.n_kept == got.kept.count()
    (tmp_path / "none.csv").write_text("id,name,height,born\n")
    none = ingest_csv(spark, f"{tmp_path}/none.csv", SPEC, f"{tmp_path}/none")
    assert (none.n_kept, none.n_rejected, none.kept.count()) == (0, 0, 0)
