import os
import time

import pytest
from pyspark.sql import functions as F

from quire.api import from_binary
from quire.kernel import writer as W
from quire.sources.datasource import pdf_table
from quire.sources.pdf import extract
from quire.sources.sink import file_name, write_documents
from quire.streaming.ingest import Ingested


def pdf(*pages):
    return W.simple_pdf([W.show_lines([p]) for p in pages])


def put(folder, name, *pages, age=10):
    path = folder / name
    path.write_bytes(pdf(*pages))
    os.utime(path, (time.time() - age, time.time() - age))
    return str(path)


def test_filters_choose_files_and_pages(spark, tmp_path):
    paths = [put(tmp_path, f"f{k}.pdf", f"a{k}", f"b{k}", f"c{k}") for k in range(4)]
    (tmp_path / "bad.pdf").write_bytes(b"no pdf at all")
    rows = lambda d: sorted((os.path.basename(r.doc_id), r.page, r.stream) for r in d.collect())
    df = pdf_table(spark, str(tmp_path))
    one = df.where((F.col("doc_id") == paths[2]) & (F.col("page") >= 1) & (F.col("page") < 2))
    assert rows(one) == [("f2.pdf", 1, "b2")]
    # what was pushed is not tested again, and no other reading gets its rows
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in plan and "= " + paths[2] not in plan.split("RelationV2")[0]
    assert len(rows(df)) == 12 and rows(df.where("page = 1 and stream like 'b%'")) == [(f"f{k}.pdf", 1, f"b{k}") for k in range(4)] and len(rows(df)) == 12
    # FAILFAST opens no file that the filter leaves out, not even a broken one
    strict = pdf_table(spark, f"file://{tmp_path}", mode="FAILFAST")
    assert rows(strict.where(F.col("doc_id").isin(paths[:2])).where("page in (0, 2)")) == [("f0.pdf", 0, "a0"), ("f0.pdf", 2, "c0"), ("f1.pdf", 0, "a1"), ("f1.pdf", 2, "c1")]
    with pytest.raises(Exception, match="bad.pdf"):
        strict.collect()
    assert rows(df.where("page = 2 or page = 0")) == sorted((f"f{k}.pdf", p, f"{c}{k}") for k in range(4) for p, c in ((0, "a"), (2, "c")))


def test_changed_files_supersede_what_they_were(spark, tmp_path):
    src, out, check = tmp_path / "src", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    src.mkdir()
    state = lambda: sorted((os.path.basename(r.doc_id), r.page, r.stream) for r in Ingested(spark, out, "page_text").rows().collect())
    whole = lambda: sorted((f.name, p, t) for f in src.glob("*.pdf") for p, t in [(r.page, r.stream) for r in extract(spark.createDataFrame([(f.name, bytearray(f.read_bytes()))], "doc_id string, content binary"), "page_text").collect()])
    assert state() == []
    put(src, "changed.pdf", "old one", "old two", age=100)
    put(src, "same.pdf", "same", age=100)
    Ingested(spark, out, "page_text").follow(str(src), check).awaitTermination(120)
    assert state() == whole() and len(state()) == 3
    put(src, "changed.pdf", "new", age=50)
    put(src, "same.pdf", "same", age=50)  # sent again as it was
    put(src, "late.pdf", "late", age=50)
    Ingested(spark, out, "page_text").follow(str(src), check).awaitTermination(120)  # a restart
    assert state() == whole() and ("changed.pdf", 0, "new") in state() and len(state()) == 3
    put(src, "changed.pdf", "old one", "old two", age=20)  # back to what it was first
    Ingested(spark, out, "page_text").follow(str(src), check).awaitTermination(120)
    assert state() == whole() and len(state()) == 4
    # a batch that is run again, and one whose log was never written, change nothing
    table = Ingested(spark, out, "page_text")
    files = spark.read.format("pdf").option("table", "files").load(str(src))
    table.take(files, 2)
    assert state() == whole()
    extract(files, "page_text").write.parquet(f"{out}/rows/batch=9")
    assert state() == whole()
    assert sorted(os.listdir(tmp_path / "out" / "log")) == ["batch=0", "batch=1", "batch=2"]


def test_one_file_for_each_document(spark, tmp_path):
    docs = [("a/b:c.pdf", pdf("one", "two")), ("é" * 300, pdf("long name")), ("..", pdf("dots")), ("plain", pdf(""))]
    corpus = from_binary(spark.createDataFrame([(k, bytearray(v)) for k, v in docs], "doc_id string, content binary").repartition(3))
    read = lambda p: {f.name: f.read_text() for f in p.rglob("*") if f.is_file()}
    out = tmp_path / "out"
    corpus.write(str(out))
    want = {file_name(k, "txt"): t for k, t in (("a/b:c.pdf", "one\ftwo"), ("é" * 300, "long name"), ("..", "dots"), ("plain", ""))}
    assert read(out) == want and all(len(n.encode()) < 255 for n in want) and "a%2Fb%3Ac.pdf.txt" in want
    with pytest.raises(Exception, match="there already"):
        corpus.write(str(out))
    corpus.write(f"file://{out}", overwrite=True)
    assert read(out) == want
    corpus.write(str(tmp_path / "json"), "json")
    assert all(t.startswith('{"metadata"') for t in read(tmp_path / "json").values())
    corpus.write(str(tmp_path / "md"), "markdown")
    assert len(read(tmp_path / "md")) == 4
    assert sorted(os.listdir(tmp_path)) == ["json", "md", "out"]  # nothing staged is left


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("text"))
    for bad in (spark.createDataFrame([("7", "again")], "doc_id string, text string"), spark.createDataFrame([(None, "y")], "doc_id string, text string")):
        with pytest.raises(Exception, match="several rows"):
            write_documents(rows.unionAll(bad), str(tmp_path / "out"))
        assert os.listdir(tmp_path) == []
    write_documents(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="several rows"):
        write_documents(rows.unionAll(rows), str(tmp_path / "out"), overwrite=True)
    assert sum(1 for f in (tmp_path / "out").rglob("*.txt")) == 200 and os.listdir(tmp_path) == ["out"]
