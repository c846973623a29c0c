import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lucerna.session import build_session

    s = build_session("tests", cores=4, spark__driver__memory="4g")
    yield s
    s.stop()


DATA = os.environ.get("LUCERNA_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def sf():
    where = f"{DATA}/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("no test data here")
    return where


@pytest.fixture(scope="session")
def empty_sf(sf, tmp_path_factory):
    """The tables without rows; the fixed ones as they are."""
    import glob
    import shutil

    import pyarrow.parquet as pq

    where = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)
        if name in ("container_sizes.parquet", "mixture_targets.parquet", "split_targets.parquet"):
            shutil.copy(f, where)
        else:
            pq.write_table(pq.read_table(f).slice(0, 0), where / name)
    return str(where)
