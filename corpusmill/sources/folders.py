"""Python data sources for what Spark has no reader for: listings of folders, and files that are one JSON list each.

Both run in tasks, a folder or file for each partition, on any store that pyarrow
reads; nothing is listed or read on the driver but the folders just below the root.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Stores that tasks read by themselves.
STORES = ("file", "s3", "gs")
#: Characters of a list that are read at once.
BLOCK = 1 << 20


def opened(path: str):
    """A path's file system and its name there."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)


class Place(InputPartition):
    """A folder or file to read, by its path; deep: with all below it."""

    def __init__(self, path: str, deep: bool = False):
        self.path, self.deep = path, deep


def _inside(path: str, deep: bool) -> Iterator[tuple[str, str, bool, int | None]]:
    """(path, name, is_dir, bytes) of what a folder holds, nothing if there is no such folder."""
    from pyarrow import fs

    files, name = opened(path)
    scheme = path.partition(":")[0] if ":" in path else "file"
    for f in files.get_file_info(fs.FileSelector(name, allow_not_found=True, recursive=deep)):
        own = f"file:{f.path}" if scheme == "file" else f"{scheme}://{f.path}"
        yield own, f.base_name, f.type == fs.FileType.Directory, None if f.type == fs.FileType.Directory else f.size


class FolderReader(DataSourceReader):
    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep

    def partitions(self) -> list[Place]:
        if not self.deep:
            return [Place(p) for p in self.paths]
        return [Place(p) for p in self.paths] + [Place(own, True) for p in self.paths for own, _, folder, _ in _inside(p, False) if folder]

    def read(self, partition: Place) -> Iterator[tuple]:
        yield from _inside(partition.path, partition.deep)


class Folder(DataSource):
    """What folders hold: (path, name, is_dir, bytes). Options: paths, a JSON list; deep, to list all below them."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, name string, is_dir boolean, bytes long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(json.loads(self.options["paths"]), self.options.get("deep", "false") == "true")


def elements(blocks: Iterator[str]) -> Iterator[str]:
    """The elements of a JSON list as JSON, read block by block; none if the text isn't a list, and up to where it breaks off."""
    decoder, text, begun = json.JSONDecoder(), "", False
    for block in blocks:
        text += block
        while True:
            text = text.lstrip() if begun else text.lstrip("﻿ \t\r\n")
            if not text:
                break
            if not begun:
                if text[0] != "[":
                    return
                begun, text = True, text[1:]
                continue
            if text[0] in ",]":
                if text[0] == "]":
                    return
                text = text[1:]
                continue
            try:
                value, end = decoder.raw_decode(text)
            except ValueError:
                break  # more of it comes
            after = text[end:].lstrip()
            if (after[0] not in ",]") if after else (text[end - 1] not in '}]"'):
                break  # a number or word goes on
            yield json.dumps(value, ensure_ascii=False)
            text = text[end:]


class ListReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Place]:
        """A partition for each file; of folders, for each file that isn't hidden."""
        out = []
        for path in self.paths:
            held = sorted(own for own, name, folder, _ in _inside(path, False) if not folder and name[0] not in "._") if self._is_folder(path) else [path]
            out += map(Place, held)
        return out or [Place("")]

    @staticmethod
    def _is_folder(path: str) -> bool:
        from pyarrow import fs

        files, name = opened(path)
        return files.get_file_info(name).type == fs.FileType.Directory

    def read(self, partition: Place) -> Iterator[tuple[str]]:
        import io

        if not partition.path:
            return
        files, name = opened(partition.path)
        try:
            stream = files.open_input_stream(name)
        except FileNotFoundError:
            return
        with io.TextIOWrapper(stream, "utf-8", errors="replace") as text:
            for element in elements(iter(lambda: text.read(BLOCK), "")):
                yield (element,)


class JsonLists(DataSource):
    """Elements of files that are one JSON list each: (value), an element's JSON. Missing files and those that aren't lists have none. Option: paths, a JSON list of files and folders."""

    @classmethod
    def name(cls) -> str:
        return "json_lists"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> ListReader:
        return ListReader(json.loads(self.options["paths"]))
