"""Large token files are read by ranges."""

import numpy as np
import pytest

from barloom.llm import token_files as T


@pytest.mark.parametrize("seekable", [True, False])
def test_a_file_is_read_in_ranges(spark, tmp_path, monkeypatch, seekable):
    if seekable:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # no task may read more of it as one row
    else:
        monkeypatch.setattr(T, "_seekable", lambda name: False)
    monkeypatch.setattr(T, "RANGE", 3)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 12, 5000).astype("<u2")
    ids[2000:2600] = 1  # a document across many ranges
    (tmp_path / "a b%20.bin").write_bytes(ids.tobytes())
    (tmp_path / "c.bin").write_bytes(np.array([9], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    try:
        found = T.blocks(spark, str(tmp_path), separator=9, header=3, block=16)
        if seekable:
            assert found.rdd.getNumPartitions() > 1
        got = sorted((r["file"][-5:], r["at"], r["n"], tuple(r["head"])) for r in T.lengths(found).collect())
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    stops = np.flatnonzero(ids == 9).tolist()
    stops += [5000] if ids[-1] != 9 else []
    want, at = [("c.bin", 0, 0, (9,))], 0
    for s in stops:
        want.append(("0.bin", at, s - at, tuple(ids[at : at + 3].tolist())))
        at = s + 1
    assert got == sorted(want)
