"""A data source that writes lines, in order, into one file a path: nothing holds a page, and pages are there only when all are written."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _files(where: str):
    """The file system of a path, which driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class PagesWriter(DataSourceWriter):
    """Rows (path, text), those of a path one after another: joined by line feeds. A task writes below a folder of its own; commit moves the pages of the tasks that
    count to their places, abort removes them. A page that was there is replaced."""

    def __init__(self, where: str):
        self.where, self.staged = where.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        files, root = _files(self.where)
        own = f"{root}/{self.staged}/{uuid.uuid4().hex}"
        at, out, done = None, None, []
        try:
            for path, text in rows:
                if path != at:
                    if out is not None:
                        out.close()
                    target = f"{own}/{path}"
                    files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out, at = files.open_output_stream(target), path
                    done.append(f"{own}/{path}"[len(root) + 1 :])
                else:
                    out.write(b"\n")
                out.write(text.encode())
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages) -> None:
        files, root = _files(self.where)
        for m in messages:
            for staged in m.paths if m is not None else ():
                target = f"{root}/{staged.split('/', 2)[2]}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                files.move(f"{root}/{staged}", target)
        self._clean(files, root)

    def abort(self, messages) -> None:
        self._clean(*_files(self.where))

    def _clean(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staged}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        return PagesWriter(self.options["path"])


def write_pages(lines: DataFrame, where: str) -> None:
    """Write lines (path, at, text) below a folder that driver and executors share. The lines of a page go to one task, which Spark sorts with spilling; a path that leads out
    of the folder is an error."""
    spark = lines.sparkSession
    spark.dataSource.register(Pages)
    bad = lines.filter("path RLIKE '(^|/)[.][.](/|$)' OR path LIKE '/%' OR path = ''").select("path").limit(1).collect()
    if bad:
        raise ValueError(f"no place for a page: {bad[0]['path']!r}")
    lines.repartition("path").sortWithinPartitions("path", "at").select("path", "text").write.format("pages").mode("append").option("path", where).save()
