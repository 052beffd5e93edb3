"""Stored pages of answers as a data source of Spark: one task per node, pages until a short one.

A folder holds ``node=<name>/page=<number>/`` with the posts of a page as JSON lines. As in
paging over a network, nobody knows beforehand how many pages a node has: reading goes on until
a page has fewer posts than the page size, or is not there. As a stream, the offset says how
many pages of each node have been read, so a query goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "node string, page int, id string, author string, title string, body string"
POST = ("id", "author", "title", "body")
NAME = "stored_pages"


class Folder:
    """A folder by path or address; names inside it are taken as they are, also those that hold % signs."""

    def __init__(self, folder: str):
        self.files, self.path = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)

    def names(self, inside: str, lead: str) -> list[str]:
        """Folders inside one that are called ``lead=...``."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/{inside}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{lead}="))

    def page(self, node: str, number: int) -> list[dict] | None:
        """The posts of a page, or None where there is no page."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/{node}/page={number}", allow_not_found=True))
        parts = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        if not parts:
            return None
        posts = []
        for part in parts:
            with self.files.open_input_stream(part, compression=None) as lines:
                posts += [json.loads(line) for line in lines.read().decode().split("\n") if line.strip()]
        return posts


class Node(InputPartition):
    """Pages of one node, from one on; up to another, or to the last."""

    def __init__(self, name: str, first: int = 0, end: int | None = None):
        super().__init__(name)
        self.first, self.end = first, end


class _Pages:
    def __init__(self, options: dict):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("pagesize", 50))

    def posts(self, part: Node | None, size: int) -> Iterator[tuple]:
        if part is None:  # a folder without nodes
            return
        folder, node, number = Folder(self.path), unquote(part.value.split("=", 1)[1]), part.first
        while part.end is None or number < part.end:
            found = folder.page(part.value, number)
            for post in found or ():
                yield (node, number, *[post.get(c) for c in POST])
            number += 1
            if found is None or len(found) < size:
                return


class PagesReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Node]:
        return [Node(n) for n in Folder(self.path).names("", "node")]

    def read(self, partition: Node) -> Iterator[tuple]:
        return self.posts(partition, self.size)


class PagesStream(_Pages, DataSourceStreamReader):
    """Offsets are the numbers of pages read, one per node; they grow with the nodes and not with the posts."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All pages that are there, up to the first gap; pages are counted by their folders and not opened."""
        folder, out = Folder(self.path), {}
        for node in folder.names("", "node"):
            have, number = {int(p.split("=")[1]) for p in folder.names(node, "page")}, 0
            while number in have:
                number += 1
            out[node] = number
        return out

    def partitions(self, start: dict, end: dict) -> list[Node]:
        return [Node(n, start.get(n, 0), pages) for n, pages in sorted(end.items()) if pages > start.get(n, 0)]

    def read(self, partition: Node) -> Iterator[tuple]:
        return self.posts(partition, 0)

    def commit(self, end: dict) -> None:
        """Nothing to forget: the pages stay where they are."""


class StoredPages(DataSource):
    """Options: path, and pageSize, by which a batch knows the last page of a node."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options)


def stored_pages(spark: SparkSession, folder: str, size: int = 50) -> DataFrame:
    """node, page, id, author, title, body of all stored pages."""
    spark.dataSource.register(StoredPages)
    return spark.read.format(NAME).option("pageSize", size).load(folder)


def arriving_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as a stream; a page is read once, as it is when it is first seen, so pages must be whole when they are moved in."""
    spark.dataSource.register(StoredPages)
    return spark.readStream.format(NAME).load(folder)


def store_pages(posts: DataFrame, folder: str) -> None:
    """Writes posts (node, page and the fields of a post) as stored pages, in addition to what is there."""
    posts.select("node", "page", *POST).repartition("node", "page").write.mode("append").partitionBy("node", "page").json(folder)
