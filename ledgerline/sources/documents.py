"""One named file per statement, through a data source of Spark.

Parts of a statement reach one task in order and are appended to one file as they
come, so a task holds one part at a time however long the statement is. A task
writes under names of its own; only when the whole job has succeeded are its files
moved to their names, so a task that runs twice or a job that fails leaves no
half-written statement behind.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerline.functions.text import download_name

SCHEMA = "folder string, document string, part bigint, text string"


def _file_system(path: str):
    """File system and path of a folder: a local one, or one of those Arrow knows by their scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (folder, name for the time being, name)."""

    files: list[tuple[str, str, str]] = field(default_factory=list)


class StatementFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statement_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StatementWriter(self.options["path"])


class StatementWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        system, root = _file_system(self.path)
        done, open_, own, attempt = Written(), None, None, uuid.uuid4().hex
        try:
            for row in iterator:
                if (row.folder, row.document) != own:
                    if open_:
                        open_.close()
                    own = (row.folder, row.document)
                    system.create_dir(f"{root}/{row.folder}", recursive=True)
                    made = (row.folder, f".{row.document}.{attempt}", row.document)
                    open_ = system.open_output_stream(f"{root}/{made[0]}/{made[1]}")
                    done.files.append(made)
                open_.write(row.text.encode())
        except BaseException:
            self.abort([done])
            raise
        finally:
            if open_:
                open_.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _file_system(self.path)
        for folder, made, name in (f for m in messages if m for f in m.files):
            system.move(f"{root}/{folder}/{made}", f"{root}/{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _file_system(self.path)
        for folder, made, _ in (f for m in messages if m for f in m.files):
            path = f"{root}/{folder}/{made}"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)


def write_statement_files(parts: DataFrame, files: DataFrame, path: str) -> None:
    """Write every statement as ``<dialect>/<digest of the file id>/<download name>`` below a path.

    ``parts`` are those of `operators.statements.documents`, ``files`` has ``(file_id, file_name)``.
    Statements of other files stay as they are; one that is there is replaced.
    """
    parts.sparkSession.dataSource.register(StatementFiles)
    named = parts.join(files.select("file_id", "file_name"), "file_id")
    folder = F.concat_ws("/", "dialect", F.md5("file_id"))
    rows = named.select(folder.alias("folder"), download_name(F.col("file_name"), F.col("dialect")).alias("document"), F.col("part").cast("bigint").alias("part"), "text")
    ordered = rows.repartition("folder", "document").sortWithinPartitions("folder", "document", "part")
    ordered.write.format("statement_files").mode("append").save(path)


def digests_of_files(parts: DataFrame) -> DataFrame:
    """``(file_id, blocks, digest)`` of every file: blocks of its parts added up, md5 of their texts one after the other.

    ``parts`` has ``(file_id, part, parts, blocks, text)``. Texts of files of a single part are digested where they are;
    the others reach one task in order, which holds a batch of parts at a time however long the file is.
    """
    long = F.col("parts") > 1
    rows = parts.select("file_id", "part", "blocks", F.when(~long, F.md5("text")).alias("digest"), F.when(long, F.col("text")).alias("text"))
    ordered = rows.repartition("file_id").sortWithinPartitions("file_id", "part")
    return ordered.mapInArrow(_digested, "file_id string, blocks bigint, digest string")


def _digested(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("file_id", pa.string()), ("blocks", pa.int64()), ("digest", pa.string())])
    open_ = None  # the file whose parts go on: its id, blocks so far, md5 so far
    for batch in batches:
        done, texts = [], batch.column("text")
        small = (batch.column(c).to_pylist() for c in ("file_id", "blocks", "digest"))
        for i, (file_id, blocks, digest) in enumerate(zip(*small)):
            if open_ and (digest is not None or open_[0] != file_id):
                done.append((open_[0], open_[1], open_[2].hexdigest()))
                open_ = None
            if digest is not None:
                done.append((file_id, blocks, digest))
                continue
            open_ = open_ or [file_id, 0, hashlib.md5(usedforsecurity=False)]
            open_[1] += blocks
            open_[2].update(texts[i].as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((open_[0], open_[1], open_[2].hexdigest()), schema)], schema=schema)
