import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from threatlens import session
    built = session.build("tests", 8)
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Builds a line DataFrame with arrival order from a list of texts."""
    def make(texts):
        return spark.createDataFrame([(t, ("p", i)) for i, t in enumerate(texts)],
                                     "value string, seq struct<part:string,pos:bigint>")
    return make


@pytest.fixture(scope="session")
def entries(lines):
    """Parsed strict entries from request parts: (ip, path, status, agent, second)."""
    from loglines import line

    from threatlens.operators import parsers

    def make(rows, profile="strict"):
        return parsers.parse_nginx(lines([line(*r) for r in rows]), profile)
    return make
