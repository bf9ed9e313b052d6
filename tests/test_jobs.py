"""Every registered job of the reference's operators against its SQL, or for rows where there is none."""

import pytest

from cmdspark.jobs import command_jobs, manual_jobs, mining_jobs, retrieval_jobs, session_jobs, source_jobs, validation_jobs

from .compare import assert_same

JOBS = {n: (f, m.SQL.get(n)) for m in (mining_jobs, session_jobs, validation_jobs, command_jobs, manual_jobs, retrieval_jobs, source_jobs) for n, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", JOBS)
def test_job(spark, sf_dir, name):
    query, sql = JOBS[name]
    df = query(spark, sf_dir)
    if sql is None:
        assert df.count() > 0
    else:
        assert_same(df, sql, sf_dir)
