"""`df.write.format("document_files")`: one file for each document."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quire.sources.datasource import opened

#: Folders that the files are dealt to by name; bytes of a name.
FOLDERS, LONGEST = 256, 200


def file_name(doc_id: str, extension: str) -> str:
    """A name for a document: its id, what file systems may not take escaped; of a long one
    the start and a digest."""
    name = quote(doc_id, safe=" ()+,;=@")
    if name.strip(".") == "" or len(name) > LONGEST:
        name = f"{name[: LONGEST - 41]}-{hashlib.sha1(doc_id.encode()).hexdigest()}"
    return f"{name}.{extension}"


def folder(doc_id: str) -> str:
    return f"{int(hashlib.sha1(doc_id.encode()).hexdigest()[:8], 16) % FOLDERS:03d}"


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    folders: list[str]


class FilesWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own beside the target. The commit
    puts those of the attempts that counted together and renames the whole to the
    target, so all files are there at once or none is; what other attempts left goes."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.extension = options["path"].rstrip("/"), options.get("extension", "txt")
        self.overwrite, self.staging = overwrite, f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, staging = opened(self.staging)
        attempt, seen, made = uuid.uuid4().hex, set(), set()
        for r in rows:
            if r["doc_id"] is None or r["doc_id"] in seen:
                raise ValueError(f"a document's id is null or on several rows: {r['doc_id']}")
            seen.add(r["doc_id"])
            own = f"{staging}/{attempt}/{(part := folder(r['doc_id']))}"
            if part not in made:
                fs.create_dir(own, recursive=True)
                made.add(part)
            with fs.open_output_stream(f"{own}/{file_name(r['doc_id'], self.extension)}") as out:
                out.write((r["text"] or "").encode())
        return Written(attempt, sorted(made))

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        _, staging = opened(self.staging)
        there = fs.get_file_info(path).type != FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is there already")
        whole = f"{staging}/whole"
        fs.create_dir(whole, recursive=True)
        for m in messages:
            for part in m.folders if m else ():
                if fs.get_file_info(f"{whole}/{part}").type == FileType.NotFound:
                    fs.move(f"{staging}/{m.attempt}/{part}", f"{whole}/{part}")
                else:  # a folder that several tasks wrote to
                    for f in fs.get_file_info(FileSelector(f"{staging}/{m.attempt}/{part}")):
                        fs.move(f.path, f"{whole}/{part}/{f.base_name}")
        old = f"{staging}/old"
        if there:
            fs.move(path, old)
        fs.move(whole, path)
        fs.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = opened(self.staging)
        if fs.get_file_info(staging).type != FileType.NotFound:
            fs.delete_dir(staging)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "doc_id string, text string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite)


def write_documents(texts: DataFrame, path: str, column: str = "text", extension: str = "txt", overwrite: bool = False) -> None:
    """Writes doc_id and a text column as one file for each document, path/NNN/name.extension,
    where NNN and name follow from the doc_id. All files appear at once; writing the same
    again with `overwrite` gives the same. A null text is an empty file; a null doc_id or
    one on several rows is an error, and then nothing is written. The path must be one that
    driver and executors both can open."""
    spark = texts.sparkSession
    spark.dataSource.register(DocumentFiles)
    own = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).cast("string").alias("text"))
    dealt = own.repartition(F.pmod(F.conv(F.substring(F.sha1(F.col("doc_id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(FOLDERS)))
    dealt.write.format("document_files").mode("overwrite" if overwrite else "append").option("extension", extension).save(path)
