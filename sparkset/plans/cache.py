"""Durable caches of datasets as Parquet tables with a manifest; entries end by age, then the oldest by size."""

from __future__ import annotations

import json
import os
import shutil
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MAX_AGE_S = 30 * 24 * 3600
MAX_BYTES = 10 * 1000**3


@dataclass
class TableCache:
    """Tables by key in a folder that driver and executors share."""

    spark: SparkSession
    folder: str
    max_age_s: float = MAX_AGE_S
    max_bytes: int = MAX_BYTES
    hits: int = field(default=0, init=False)
    misses: int = field(default=0, init=False)

    def _manifest(self) -> dict[str, dict]:
        try:
            with open(f"{self.folder}/manifest.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _store(self, manifest: dict[str, dict]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/manifest.json.new", "w") as f:
            json.dump(manifest, f)
        os.replace(f"{self.folder}/manifest.json.new", f"{self.folder}/manifest.json")

    def get(self, key: str) -> DataFrame | None:
        entry = self._manifest().get(key)
        if entry is None or time.time() - entry["made"] > self.max_age_s or not os.path.isdir(f"{self.folder}/{entry['table']}"):
            self.misses += 1
            return None
        self.hits += 1
        return self.spark.read.parquet(f"file://{os.path.abspath(self.folder)}/{entry['table']}")

    def put(self, key: str, df: DataFrame) -> DataFrame:
        table = f"t_{time.time_ns():x}"
        df.write.parquet(f"file://{os.path.abspath(self.folder)}/{table}")
        size = sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(f"{self.folder}/{table}") for x in names)
        manifest = self._manifest()
        if old := manifest.get(key):
            shutil.rmtree(f"{self.folder}/{old['table']}", ignore_errors=True)
        self._store(manifest | {key: {"table": table, "made": time.time(), "bytes": size}})
        return self.spark.read.parquet(f"file://{os.path.abspath(self.folder)}/{table}")

    def cached(self, key: str, make) -> DataFrame:
        found = self.get(key)
        return self.put(key, make()) if found is None else found

    def invalidate(self, key: str) -> None:
        manifest = self._manifest()
        if entry := manifest.pop(key, None):
            shutil.rmtree(f"{self.folder}/{entry['table']}", ignore_errors=True)
            self._store(manifest)

    def list(self) -> list[str]:
        return sorted(self._manifest())

    def cleanup(self) -> list[str]:
        """Drop entries that are too old, then the oldest until the rest fits; returns their keys."""
        manifest, gone = self._manifest(), []
        for key, e in sorted(manifest.items(), key=lambda x: x[1]["made"]):
            if time.time() - e["made"] > self.max_age_s or sum(x["bytes"] for k, x in manifest.items() if k not in gone) > self.max_bytes:
                gone.append(key)
        for key in gone:
            self.invalidate(key)
        return gone

    def clear_all(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def stats(self) -> dict[str, int]:
        entries = self._manifest().values()
        return {"entries": len(entries), "bytes": sum(e["bytes"] for e in entries), "hits": self.hits, "misses": self.misses}
