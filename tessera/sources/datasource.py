"""A Python data source for scenes that another program has tessellated.

Each line of a JSON-lines file is an occurrence; geometry kernels that write such
files plug in here without further code.  It reads folders that all executors
mount; ``formats.scene_occurrences`` reads the same files from any store.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        path = self.path.removeprefix("file://")
        return [_File(p) for p in (sorted(glob.glob(os.path.join(path, "*.jsonl"))) if os.path.isdir(path) else [path])]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    x = json.loads(line)
                    yield (x.get("occ_id"), x.get("source_label"), x.get("geometry_key"), x.get("material_key"), bool(x.get("from_explicit")), int(x.get("triangles") or 0))


class SceneSource(DataSource):
    """``spark.dataSource.register(SceneSource)``, then ``spark.read.format("scene")``."""

    @classmethod
    def name(cls) -> str:
        return "scene"

    def schema(self) -> str:
        return "occ_id bigint, source_label string, geometry_key string, material_key string, from_explicit boolean, triangles bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
