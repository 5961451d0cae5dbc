"""Compaction keeps files of bounded size, however few the rows."""

import uuid

from corvid.sources.store import Store


def test_compacted_files_have_bounded_bytes(spark, tmp_path):
    held = Store(spark, str(tmp_path / "store"))
    for part in range(2):
        held.add(spark.createDataFrame([(100 * part + i, uuid.uuid4().hex * 50) for i in range(40)], "id long, text string"))
    size = sum(f["bytes"] for f in held.snapshot().files.values())
    held.compact(most_bytes=size // 3)
    assert len(held.files()) >= 3 and held.read().count() == 80
