"""Which files of a repository of data belong to which configuration and split."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from typing import Protocol

from sparkset.sources.formats import UnknownFormat, detect

#: Names of splits.
SPLITS = ("train", "test", "validation", "valid", "val", "dev")
_CANONICAL = {"valid": "validation", "val": "validation", "dev": "validation"}


class SplitNotFound(KeyError):
    pass


class Source(Protocol):
    """Where files come from."""

    def list_files(self, repo: str) -> list[dict]: ...

    def download(self, repo: str, path: str) -> str: ...

    def exists(self, repo: str) -> bool: ...


class LocalSource:
    """Folders of the driver's file system."""

    def list_files(self, repo: str) -> list[dict]:
        out = []
        for folder, _, names in os.walk(repo):
            for n in sorted(names):
                full = os.path.join(folder, n)
                try:
                    kind = detect(full)[0]
                except UnknownFormat:
                    kind = "unknown"
                out.append({"path": os.path.relpath(full, repo), "size": os.path.getsize(full), "format": kind})
        return sorted(out, key=lambda f: f["path"])

    def download(self, repo: str, path: str) -> str:
        return os.path.join(repo, path)

    def stream(self, repo: str, path: str, size: int = 65536) -> Iterable[bytes]:
        with open(self.download(repo, path), "rb") as f:
            yield from iter(lambda: f.read(size), b"")

    def exists(self, repo: str) -> bool:
        return os.path.exists(repo)


class HadoopSource:
    """Any store that Spark's Hadoop file systems reach."""

    def __init__(self, spark):
        self.spark = spark

    def _fs(self, repo: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(repo)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list_files(self, repo: str) -> list[dict]:
        root, fs = self._fs(repo)
        base, files, out = fs.makeQualified(root).toString().rstrip("/"), fs.listFiles(root, True), []
        while files.hasNext():
            f = files.next()
            path = f.getPath().toString().removeprefix(base + "/")
            try:
                kind = detect(path)[0]
            except UnknownFormat:
                kind = "unknown"
            out.append({"path": path, "size": f.getLen(), "format": kind})
        return sorted(out, key=lambda f: f["path"])

    def download(self, repo: str, path: str) -> str:
        return f"{repo.rstrip('/')}/{path}"

    def exists(self, repo: str) -> bool:
        path, fs = self._fs(repo)
        return fs.exists(path)


def split_of(path: str) -> str | None:
    """Split that a file name or folder names."""
    parts = re.split(r"[/\\]", path.lower())
    for part in reversed(parts):
        for word in re.split(r"[^a-z]+", part):
            if word in SPLITS:
                return _CANONICAL.get(word, word)
    return None


def resolve(files: Iterable[str], config: str | None = None, split: str | None = None) -> tuple[str, dict[str, list[str]]]:
    """Configuration and files by split.

    Files in a folder named otherwise than data or a split are a configuration's. Taken is the one asked for, or else default, main or
    the first; files that name no split are train.
    """
    configs: dict[str, dict[str, list[str]]] = {}
    for path in sorted(files):
        try:
            detect(path)
        except UnknownFormat:
            continue
        head = path.split("/")[0] if "/" in path else "default"
        name = "default" if head.lower() == "data" or split_of(head) else head
        configs.setdefault(name, {}).setdefault(split_of(path) or "train", []).append(path)
    if not configs:
        raise FileNotFoundError("no data files")
    if config is not None and config not in configs:
        raise KeyError(f"no configuration {config}; there are {sorted(configs)}")
    chosen = config or next((c for c in ("default", "main") if c in configs), sorted(configs)[0])
    found = configs[chosen]
    if split is not None:
        if split not in found:
            raise SplitNotFound(split)
        found = {split: found[split]}
    return chosen, found


def configs_of(files: Iterable[str]) -> list[str]:
    return sorted({p.split("/")[0] if "/" in p and p.split("/")[0].lower() != "data" and not split_of(p.split("/")[0]) else "default" for p in files})


Splits = Mapping[str, list[str]]
