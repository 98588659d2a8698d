import numpy as np
import pyarrow as pa

from barloom.llm import repeats as R


def in_chunks(chunks, width, cells, ranges, monkeypatch):
    """The first three steps without Spark: each chunk's candidates, and how many windows each grouped exactly."""
    ids = [pa.scalar(i, pa.int32()) for i in range(len(chunks))]
    asks = pa.concat_tables([R._asks(width, cells, ranges)((i,), t) for i, t in zip(ids, chunks)])
    col = asks.column("rng").to_numpy()
    answers = pa.concat_tables([R._estimated(-(-cells // ranges))(None, asks.filter(pa.array(col == r))) for r in np.unique(col)])
    sizes, real = [], R._grouped
    monkeypatch.setattr(R, "_grouped", lambda a, b: sizes.append(len(a)) or real(a, b))
    some = [R._candidates(width, cells, ranges)((i,), t, answers.filter(pa.array(answers.column("chunk").to_numpy() == i.as_py()))) for i, t in zip(ids, chunks)]
    return some, sizes


def table(rows):
    return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "key": pa.array(range(len(rows)), pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_only_windows_estimated_repeated_are_grouped(monkeypatch):
    # 81 windows that occur once; 31 twice in one chunk; 11 in both chunks
    one = table([(1, words(0, 100)), (2, words(1000, 1050)), (3, words(1000, 1050)), (4, words(2000, 2030))])
    two = table([(5, words(3000, 3100)), (6, words(2000, 2030)), (7, None), (8, "")])
    some, sizes = in_chunks([one, two], 20, 100_003, 3, monkeypatch)
    assert sizes == [31 * 2 + 11, 11]
    count = lambda t, name, size: sum(len(b) // size for b in t.column(name).to_pylist())
    assert [count(t, "h1", 8) for t in some] == [11, 11]  # repeats inside a chunk stay there
    assert [count(t, "again", 4) for t in some] == [31, 0]


def test_a_crowded_sketch_loses_no_window(monkeypatch):
    one = table([(1, words(0, 60)), (2, words(0, 60) + " x")])
    two = table([(3, words(10, 70))])
    some, sizes = in_chunks([one, two], 20, 2, 1, monkeypatch)  # two cells a row: all are estimated repeated
    assert sizes == [41 + 42, 41]
    assert [sum(len(b) // 4 for b in t.column("again").to_pylist()) for t in some] == [41, 0]


def test_counts_of_a_chunk_stop_at_255():
    got = R._asks(2, 64, 1)((pa.scalar(0, pa.int32()),), table([(1, "a b " * 400)]))
    counts = [np.frombuffer(R.zlib.decompress(b), np.uint8) for b in got.column("counts").to_pylist()]
    assert [sorted(c.tolist()) for c in counts] == [[255, 255]] * R.ROWS
    one = R._estimated(64)(None, got.slice(0, 1))
    assert np.unpackbits(np.frombuffer(one.column("repeated")[0].as_py(), np.uint8))[:2].tolist() == [1, 1]
    assert not any(one.column("elsewhere")[0].as_py())
