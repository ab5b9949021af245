"""Publishing to and reading from a hub of datasets, through a client that the user supplies."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from sparkset.operators.dataset import Dataset
from sparkset.operators.splits import SplitDict
from sparkset.sources.sinks import shard_rows, to_parquet

UPLOADS = 4


class PartialUpload(RuntimeError):
    pass


class Client(Protocol):
    def create_repo(self, repo: str, private: bool) -> None: ...

    def upload(self, repo: str, path: str, local: str) -> None: ...

    def list_files(self, repo: str) -> list[str]: ...

    def delete(self, repo: str, path: str) -> None: ...

    def download(self, repo: str, path: str, local: str) -> None: ...


class FolderClient:
    """A hub in a local folder, for tests and offline use."""

    def __init__(self, root: str):
        self.root = root

    def create_repo(self, repo: str, private: bool = False) -> None:
        os.makedirs(f"{self.root}/{repo}", exist_ok=True)

    def upload(self, repo: str, path: str, local: str) -> None:
        target = f"{self.root}/{repo}/{path}"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(local, "rb") as r, open(target, "wb") as w:
            w.write(r.read())

    def list_files(self, repo: str) -> list[str]:
        base = f"{self.root}/{repo}"
        return sorted(os.path.relpath(os.path.join(d, n), base) for d, _, names in os.walk(base) for n in names)

    def delete(self, repo: str, path: str) -> None:
        os.remove(f"{self.root}/{repo}/{path}")

    def download(self, repo: str, path: str, local: str) -> None:
        with open(f"{self.root}/{repo}/{path}", "rb") as r, open(local, "wb") as w:
            w.write(r.read())


def shard_name(config: str, split: str, index: int, total: int) -> str:
    return f"{config}/{split}/data-{index:05d}-of-{total:05d}.parquet"


def dataset_card(d: Dataset, repo: str) -> str:
    columns = "\n".join(f"- {c}" for c in sorted(d.column_names))
    return f"---\nlicense: {d.metadata.get('license', 'unknown')}\n---\n\n# {repo}\n\nRows: {len(d)}\n\n## Columns\n\n{columns}\n"


def _shards(d: Dataset, folder: str, rows: int) -> list[str]:
    """Parquet files of so many rows, written by the executors to the folder they share and copied to one of the driver's."""
    spark = d.spark
    shared = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{folder}").rstrip("/")
    path = f"{shared}/sparkset-push-{uuid.uuid4().hex}"
    to_parquet(d, path, max_rows=rows)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for f in sorted(x.getPath().toString() for x in fs.listStatus(target) if x.getPath().getName().startswith("part-")):
        out.append(f"{folder}/{os.path.basename(f)}")
        fs.copyToLocalFile(False, spark._jvm.org.apache.hadoop.fs.Path(f), spark._jvm.org.apache.hadoop.fs.Path(f"file://{out[-1]}"), True)
    fs.delete(target, True)
    return out


def push(d: Dataset | SplitDict, repo: str, client: Client, config: str = "default", split: str = "train", private: bool = False, max_shard_bytes: int = 500 * 1024 * 1024) -> list[str]:
    """Write Parquet shards with Spark, upload four at a time, and add a card. Returns the paths."""
    if isinstance(d, SplitDict):
        done, wrong = [], {}
        for name, part in d.items():
            try:
                done += push(part, repo, client, config, name, private, max_shard_bytes)
            except Exception as e:
                wrong[name] = e
        if wrong:
            raise PartialUpload(f"splits not uploaded: {wrong}")
        return done
    client.create_repo(repo, private)
    with tempfile.TemporaryDirectory() as folder:
        files = _shards(d, folder, shard_rows(d, max_shard_bytes))
        names = [shard_name(config, split, i, len(files)) for i in range(len(files))]
        with ThreadPoolExecutor(UPLOADS) as pool:
            list(pool.map(lambda x: client.upload(repo, *x), zip(names, files)))
        with open(f"{folder}/README.md", "w") as f:
            f.write(dataset_card(d, repo))
        client.upload(repo, "README.md", f"{folder}/README.md")
    return names


def delete(repo: str, client: Client, config: str) -> list[str]:
    gone = [p for p in client.list_files(repo) if p.startswith(f"{config}/")]
    with ThreadPoolExecutor(UPLOADS) as pool:
        list(pool.map(lambda p: client.delete(repo, p), gone))
    return gone


class HubSource:
    """A hub's files as a source: downloaded to a folder once for each revision that the client reads."""

    def __init__(self, client: Client, folder: str):
        self.client, self.folder = client, folder

    def list_files(self, repo: str) -> list[dict]:
        from sparkset.sources.formats import UnknownFormat, detect

        out = []
        for p in self.client.list_files(repo):
            try:
                out.append({"path": p, "size": None, "format": detect(p)[0]})
            except UnknownFormat:
                continue
        return out

    def exists(self, repo: str) -> bool:
        return self.client.exists(repo) if hasattr(self.client, "exists") else bool(self.client.list_files(repo))

    def cache_path(self, repo: str, path: str) -> str:
        revision = getattr(self.client, "revision", "main")
        at = repo.replace("/", "--") + ("" if revision == "main" else "@" + revision.replace("/", "--"))
        return os.path.join(self.folder, at, path)

    def cached(self, repo: str, path: str) -> bool:
        return os.path.exists(self.cache_path(repo, path))

    def download(self, repo: str, path: str) -> str:
        target = self.cache_path(repo, path)
        if not os.path.exists(target):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            self.client.download(repo, path, target + ".part")
            os.replace(target + ".part", target)
        return target
