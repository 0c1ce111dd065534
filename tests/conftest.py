import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flatloom-tests-"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """Write byte files into a fresh folder and return its path."""

    def write(files: dict[str, bytes | str], name: str = "in") -> str:
        root = tmp_path / name
        root.mkdir(exist_ok=True)
        for file, content in files.items():
            (root / file).write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(root)

    return write


@pytest.fixture
def small_splits(spark):
    """Cut files into splits of 1500 bytes, so that records cross borders."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1500b")
    yield
    spark.conf.set(name, before)


@pytest.fixture
def tiny_splits(spark):
    """Cut files into splits of 40 bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "40b")
    yield
    spark.conf.set(name, before)


def by_file(rows, *columns):
    """{file id: sorted tuples of the given columns}"""
    found = {}
    for r in rows:
        file = r.src_file.rsplit("/", 1)[1].split(".")[0]
        found.setdefault(file, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=lambda t: (t[0] is None, t)) for k, v in found.items()}
