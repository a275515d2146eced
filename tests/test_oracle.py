"""Every SQL-checked query outside llm against its DuckDB twin at sf0.001.

The queries of the tests that were selected run a few at a time in the background, as most of their time at this size is
the scheduling of small jobs; each test then waits for its own.
"""

from multiprocessing.pool import ThreadPool

import pytest
from pyspark import inheritable_thread_target

from check_oracle import canon, type_mismatches
from lowdata.plans.registry import QUERIES
from tests.conftest import SMALL

AT_ONCE = 4


def _names():
    import __spark_entry__ as E
    return sorted(n for n in E.oracle_sql() if n in QUERIES)


@pytest.fixture(scope="module")
def results(spark, request):
    import __spark_entry__ as E
    qs = E.queries()

    def run(name):
        df = qs[name](spark, SMALL)
        return df.dtypes, [tuple(r) for r in df.collect()]
    wanted = [i.callspec.params["name"] for i in request.session.items if i.fspath == request.node.fspath and hasattr(i, "callspec")]
    with ThreadPool(AT_ONCE) as pool:
        yield {n: pool.apply_async(inheritable_thread_target(spark)(run), (n,)) for n in wanted}


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(results, duck, name):
    import __spark_entry__ as E
    dtypes, rows = results[name].get()
    cols = [c for c, _ in dtypes]
    rel = duck(SMALL).execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert not type_mismatches(dtypes, rel.description)
    assert canon(rows, cols) == canon(drows, dcols)


def test_every_query_has_docstring_and_runs_entry(spark):
    import __spark_entry__ as E
    qs = E.queries()
    assert len(qs) >= 80
    out = E.entry(spark)
    assert set(out.columns) >= {"window_id", "auc", "f1", "mcc"}
    assert out.count() >= 0
