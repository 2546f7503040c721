"""File fingerprints split by split against hashlib."""

import hashlib

import numpy as np
import pytest

from tabwright.sources import state


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_task_reads_a_large_file_whole(spark, tmp_path, small_splits):
    noise = np.random.default_rng(5).integers(0, 256, 40_000, np.uint8).tobytes()
    files = {"plain": noise, "ends [x]": noise + b"\n", "ends twice": noise + b"\n\n", "mark": b"\xef\xbb\xbf\n\r\n" + noise, "mark ends": b"\xef\xbb\xbf" + noise + b"\n",
             "starts": b"\n\n" + noise, "one line": bytes(30_000), "newlines": b"\n" * 20_000, "packed {a}.gz": noise, "small": b"abc\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    assert state.split_lines(spark, str(tmp_path / "plain")).rdd.getNumPartitions() > 3
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in state.file_sha256(spark, str(tmp_path), whole=10_000).collect()}
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in files.items()}
