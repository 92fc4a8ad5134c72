"""Writers that replace a file or folder whole or not at all."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sequences import Names
from ledgerline.sources.models import filesystem, get


def json_file(path: str | Path, blocks: Iterable[dict]) -> None:
    """Write {"documents": [...]} beside the target, then rename over it: indented by 2, UTF-8, a line feed at the end."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_suffix(target.suffix + ".part")
    with beside.open("w", encoding="utf-8") as f:
        json.dump({"documents": list(blocks)}, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(beside, target)


def as_dicts(blocks: DataFrame, order: Names = ("block_no",)) -> Iterable[dict]:
    """Rows of blocks in order, one at a time, as plain dicts without the order columns."""
    for row in blocks.orderBy(*order).toLocalIterator():
        d = row.asDict(recursive=True)
        yield {k: v for k, v in d.items() if k not in order}


def statements_json(blocks: DataFrame, path: str | Path, order: Names = ("block_no",)) -> None:
    """The one-file form of the statements table; rows stream through the driver."""
    json_file(path, as_dicts(blocks, order))


def swapped_parquet(df: DataFrame, path: str) -> None:
    """Write a folder beside the target and rename it into place, on whatever file system the path names."""
    spark = df.sparkSession
    jvm = spark._jvm
    target, beside, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".part", ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(beside, True)
    df.write.parquet(path + ".part")
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(beside, target)
    fs.delete(old, True)


def commit(paths: Iterable[str], target: str | Path, scratch: str | Path) -> tuple[int, list[str]]:
    """(exit code, documents without statements) of putting scratch files together, in the order given, into the target.

    No statement at all: nothing is written, the old file stays, code 1, scratch stays.  Else the file is
    written and scratch removed; code 1 if some document had no statements, 0 otherwise.  One file is held at a time.
    """
    files, root = filesystem(str(target))
    beside, empty, some = f"{root}.part", [], 0
    files.create_dir(root.rpartition("/")[0] or ".", recursive=True)
    with files.open_output_stream(beside) as out:
        out.write(b'{\n  "documents": [')
        for k, path in enumerate(paths):
            own, place = filesystem(path)
            for block in json.loads(get(own, place) or '{"documents": []}')["documents"]:
                some += len(block["statements"])
                empty += [] if block["statements"] else [block["id"]]
                text = json.dumps(block, ensure_ascii=False, indent=2).replace("\n", "\n    ")
                out.write(f"{',' if k else ''}\n    {text}".encode())
        out.write(b"\n  ]\n}\n")
    if not some:
        files.delete_file(beside)
        return 1, empty
    files.move(beside, root)
    rest, folder = filesystem(str(scratch))
    if rest.get_file_info(folder).type == FileType.Directory:
        rest.delete_dir(folder)
    return int(bool(empty)), empty


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def vocabulary(path: str | Path, topics: Iterable[str] | None = None) -> set[str]:
    """Read a topic vocabulary (empty if there is none), or write it sorted."""
    file = Path(path)
    if topics is not None:
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(sorted(set(topics)), indent=2, ensure_ascii=False), encoding="utf-8")
        return set(topics)
    return set(json.loads(file.read_text(encoding="utf-8"))) if file.exists() else set()


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint, so that what follows neither plans nor computes them again and outlives lost executors.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
