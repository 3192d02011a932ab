import pyarrow as pa
from pyspark.sql import functions as F

from quire.sources import pdf, synth
from quire.sources.pdf import extract
from quire.kernel import writer as W


def largest(df, column):
    """Bytes of the largest batch that Python gets of df."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return df.select(column).mapInArrow(run, "n long").agg(F.max("n")).first()[0]


def test_batches_are_bounded_by_bytes(spark):
    """40 MB of texts in one task: no batch has more than a few."""
    texts = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 2000).alias("text"))
    files = synth.synthesize(texts, lambda r: W.simple_pdf([W.show_lines([r["text"]])]), "id")
    n = largest(files, "content")
    assert 0 < n < 8 << 20
    assert extract(files, "page_text").where("length(plain) = 20000").count() == 2000


def test_what_is_sent_on_is_bounded_by_bytes(spark, monkeypatch):
    sizes = []
    whole = pdf._batch
    monkeypatch.setattr(pdf, "_batch", lambda rows, arrow: sizes.append(len(rows)) or whole(rows, arrow))
    run = {}
    monkeypatch.setattr(pdf, "BYTES", 10_000)
    frame = spark.createDataFrame([("a", bytearray(b""))], "doc_id string, content binary")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    extract(frame, "page_text")
    monkeypatch.undo()
    one = W.simple_pdf([W.show_lines(["x" * 3000])])
    monkeypatch.setattr(pdf, "_batch", lambda rows, arrow: sizes.append(len(rows)) or whole(rows, arrow))
    monkeypatch.setattr(pdf, "BYTES", 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(50)]), pa.array([one] * 50, pa.binary())], ["doc_id", "content"])
    out = list(run["f"](iter([batch])))
    assert sum(b.num_rows for b in out) == 50 and max(sizes) <= 10_000 // len(one) + 1
