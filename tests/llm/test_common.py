import pyarrow as pa
import pytest

from quire.llm import bpe, common, langid, linededup, nearcopies, simhash


def test_slices_by_rows_and_bytes():
    texts = ["a" * n for n in (5, 100, 3, 3, 3, 3, 250, 1)] + [None, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["doc_id", "text"])
    for rows, size in ((3, 1000), (100, 100), (4, 7), (1, 1)):
        parts = list(common.slices(iter([b]), rows, size))
        assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
        assert all(p.num_rows <= rows and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= size) for p in parts)
    assert list(common.slices(iter([b.slice(0, 0)]))) == []


def test_free_names():
    assert common.free("n", ["a"]) == "n" and common.free("n", ["N", "n_", "x"]) == "n__"


@pytest.mark.parametrize("use", [simhash.near_duplicates, nearcopies.keep_one, bpe.tokenize, lambda d: linededup.dedup_lines(d), lambda d: langid.identify(d, langid.fit(d))])
def test_the_session_stays_as_it_was(spark, sample, use):
    before = dict(spark.conf.getAll)
    use(sample).count()
    assert dict(spark.conf.getAll) == before
