"""A folder of Markdown files as a data source: `spark.read.format("markdown_folder").load(root)`.

Files end in `.md`, in any folder below the root but those whose names begin with a dot (files may); other names that
Spark's own readers hide are read. Paths are sorted and dealt into groups, one partition each; only names go through the
planner, texts are read in tasks. Any file system that pyarrow opens by its address will do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, text string, updated_at timestamp"
#: Files of a partition.
GROUP = 1000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class _Reader(DataSourceReader):
    def __init__(self, root: str, group: int):
        self.root, self.group = root, group

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = _opened(self.root)
        top, found, todo = top.rstrip("/"), [], [top.rstrip("/")]
        while todo:
            for x in system.get_file_info(fs.FileSelector(todo.pop())):
                if x.type == fs.FileType.Directory and not x.base_name.startswith("."):
                    todo.append(x.path)
                elif x.type == fs.FileType.File and x.base_name.endswith(".md") and x.base_name != ".md":
                    found.append(x.path[len(top) + 1 :])
        found.sort(key=lambda p: p.split("/"))
        return [_Files(found[k : k + self.group]) for k in range(0, len(found), self.group)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, top = _opened(self.root)
        for path in partition.paths:
            where = f"{top.rstrip('/')}/{path}"
            with system.open_input_stream(where) as f:
                text = f.read().decode()
            yield path, text, system.get_file_info(where).mtime.replace(tzinfo=None)


class MarkdownFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("group", GROUP)))


def markdown_folder(spark: SparkSession, root: str, group: int = GROUP) -> DataFrame:
    """(path, text, updated_at) of the files below `root`; a file that isn't UTF-8 is an error."""
    spark.dataSource.register(MarkdownFolder)
    return spark.read.format("markdown_folder").option("group", group).load(root)
