import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyrill.session import build_session

    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plain(value):
    """A value as both engines would show it."""
    if value is None or value != value or str(value) in ("NaT", "<NA>"):
        return ""
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26].replace("+00:00", "").removesuffix(".000000")
    if isinstance(value, (bool, str)):
        return value
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return [plain(v) for v in value]
    return int(value) if float(value).is_integer() else float(value)


def same_as_sql(df, sql, folder):
    """Asserts that a result and its SQL hold the same rows under the same names."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    want = con.execute(sql)
    names = sorted(df.columns)
    order = [d[0] for d in want.description]
    assert names == sorted(order)
    theirs = sorted(repr([plain(r[order.index(n)]) for n in names]) for r in want.fetchall())
    ours = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert ours == theirs
