"""A data source that replays stored pages: ``spark.read.format("stored_pages")``, batch or streaming.

The offset of the stream is the number of the last page taken, as a cursor is for the service the pages came from.
Options: ``path`` (a folder of JSON files, one page each, in order of name) and ``pages_per_task``.
"""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page_number long, file_name string, request_hash string, payload string"


def request_hash(payload: str) -> str:
    """SHA-256 of the canonical request a page carries (``request`` in its envelope, keys sorted), else of its content.

    The file's name plays no part: a renamed page is the same page, another page of the same name is not."""
    import hashlib

    try:
        page = json.loads(payload)
    except ValueError:
        page = None
    request = page.get("request") if isinstance(page, dict) else None
    text = json.dumps(request, sort_keys=True, separators=(",", ":")) if request is not None else payload
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(files: list[str], first: int):
    for i, f in enumerate(files):
        with open(f, encoding="utf-8") as h:
            payload = h.read()
        yield first + i, os.path.basename(f), request_hash(payload), payload


class _Reader(DataSourceReader):
    def __init__(self, files: list[str]) -> None:
        self.files = files

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.files))]

    def read(self, partition):
        yield from _rows([self.files[partition.value]], partition.value)


class _Slice(InputPartition):
    def __init__(self, first: int, files: list[str]) -> None:
        self.first, self.files = first, files


class _Stream(DataSourceStreamReader):
    """A batch is all pages that have come in, read in slices of ``most`` pages by different tasks."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def _files(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.path, "*.json")))

    def initialOffset(self):
        return {"page": 0}

    def latestOffset(self):
        return {"page": len(self._files())}

    def partitions(self, start, end):
        files = self._files()
        return [_Slice(i, files[i : min(i + self.most, end["page"])]) for i in range(start["page"], end["page"], self.most)]

    def read(self, partition):
        yield from _rows(partition.files, partition.first)

    def commit(self, end):
        pass


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(sorted(glob.glob(os.path.join(self.options["path"], "*.json"))))

    def streamReader(self, schema):
        return _Stream(self.options["path"], int(self.options.get("pages_per_task", "10")))


def page_cursor(payload: str) -> str | None:
    return (json.loads(payload).get("meta") or {}).get("next_cursor")
