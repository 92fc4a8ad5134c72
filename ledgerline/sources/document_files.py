"""Writer "document_files": one JSON file a document, on any file system that all executors reach.

Each task stages its files under names of its own and tells the driver what it has staged; when all tasks are through, the
driver moves the files to their places, and if one isn't, it removes what was staged: a write is there as a whole or not
at all.  A document that is written again replaces its file, so a micro-batch may be repeated.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerline.sources.models import filesystem, put

STAGED = "_staged"


@dataclass
class Staged(WriterCommitMessage):
    """(staged path, final path) of a task's files."""

    files: list[tuple[str, str]]


class DocumentFiles(DataSource):
    """Option ``path``: the folder; column ``id`` names the file."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = filesystem(self.path)
        own, done = f"{root}/{STAGED}/{uuid.uuid4().hex}", []
        for k, row in enumerate(iterator):
            block = row.asDict(recursive=True)
            staged = f"{own}/{k}.json"
            put(files, staged, text_of([block]))
            done.append((staged, file_of(root, block["id"])))
        return Staged(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = filesystem(self.path)
        for staged, final in _of(messages):
            files.create_dir(final.rpartition("/")[0], recursive=True)
            files.move(staged, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = filesystem(self.path)
        for staged, _final in _of(messages):
            files.delete_file(staged)


def _of(messages: list[WriterCommitMessage | None]) -> Iterator[tuple[str, str]]:
    return (f for m in messages if isinstance(m, Staged) for f in m.files)


def _plain(value):
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} is no JSON")


def text_of(blocks: list[dict]) -> str:
    """The file's form: indented by 2, a line feed at the end."""
    return json.dumps({"documents": blocks}, ensure_ascii=False, indent=2, default=_plain) + "\n"


def file_of(root: str, doc_id: str) -> str:
    """Where a document's file is; ids may name folders, other odd characters are escaped."""
    return f"{root.rstrip('/')}/{quote(doc_id, safe='/ ')}.json".replace("/../", "/%2E%2E/")


def write(blocks: DataFrame, path: str) -> None:
    """Blocks (id and the fields of the file) to their files."""
    blocks.sparkSession.dataSource.register(DocumentFiles)
    blocks.write.format("document_files").mode("append").option("path", path).save()


def written(path: str) -> list[str]:
    """Files of a folder that are in their places, sorted."""
    files, root = filesystem(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".json") and "/_" not in f.path[len(root) :])


def removed(path: str) -> None:
    """The folder with all that is in it goes."""
    files, root = filesystem(path)
    if files.get_file_info(root).type == fs.FileType.Directory:
        files.delete_dir(root)
