from __future__ import annotations

import pytest

from repoloom.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "repoloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tree(spark):
    """Files of several repositories from {repo: {path: content}}."""

    def make(repos: dict[str, dict[str, str]]):
        rows = [(repo, path, text) for repo, files in repos.items() for path, text in files.items()]
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return make


def by_repo(rows, *fields):
    """{repo: {first field: rest}} of collected rows."""
    out: dict = {}
    for r in rows:
        first, *rest = [r[f] for f in fields]
        out.setdefault(r.repo, {})[first] = rest[0] if len(rest) == 1 else tuple(rest)
    return out
