import os

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tessera.operators import clustering
from tessera.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, rows_of, sql_rows

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Where the least scale leaves a query nothing, as that of the parts, whose masks are all undersegmented there.
LARGER = "/root/testdata/sf0.01"


def test_registry():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    for at in (DATA, LARGER):
        names, rows = rows_of(QUERIES[name](spark, at))
        assert (names, rows) == sql_rows(connect(at), ORACLE_SQL[name])
        if rows:
            break
    assert rows


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@needs_data
def test_whole_pipeline_runs_all_rounds(spark, monkeypatch):
    rounds = []
    cluster = clustering.cluster
    monkeypatch.setattr(clustering, "cluster", lambda *a, **k: rounds.append(k.get("rounds")) or cluster(*a, **k))
    assert QUERIES["whole_pipeline_objects"](spark, DATA).columns and rounds == [None]


@needs_data
def test_least_scale_has_no_valid_part(spark):
    """Why ``whole_pipeline_objects`` is empty there: by SQL, too, no mask is valid."""
    names, rows = sql_rows(connect(DATA), ORACLE_SQL["undersegmented"])
    at = names.index("valid")
    assert rows and not any(r[at] for r in rows) and QUERIES["whole_pipeline_objects"](spark, DATA).count() == 0


@needs_data
def test_points_of_documents_have_a_fixed_size(spark):
    """No text is dealt with the incidences of documents; as many points as different lines, and each has its line."""
    from tessera.queries import docs_state
    from tessera.sources import adapters

    inc, masks, *_ = docs_state(spark, DATA)
    assert dict(inc.dtypes)["point_id"] == "struct<h1:bigint,h2:bigint,n:int>"
    text = adapters.docs_lines(spark, DATA)
    assert inc.count() == text.count()
    lines = [r.line for r in adapters.lines_of(spark, DATA, masks).join(inc.select("point_id").distinct(), F.col("point") == F.col("point_id")).where("char_length(line) = point.n").collect()]
    assert len(lines) == len(set(lines)) and set(lines) == {r.point_id for r in text.select("point_id").distinct().collect()}
