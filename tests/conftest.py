from pathlib import Path

import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    # Tiny tables: fusing whole stages would take longer than running them.
    s = session("local[4]", 2, **{"spark.sql.codegen.wholeStage": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


DATA = Path("/root/testdata/sf0.01")
