import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkrec.session import local_session

    return local_session(cores="*", shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes the given rows as the tables of a folder, with clashing extra columns."""

    def make(**rows):
        for name, (schema, data) in rows.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
