"""Downloads to a cache by the hash of the address, and unpacking of archives."""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import tarfile
import urllib.request
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor


def fetch_url(url: str, target: str) -> None:
    with urllib.request.urlopen(url) as r, open(target, "wb") as f:
        shutil.copyfileobj(r, f)


class DownloadManager:
    """``fetch`` copies an address to a path; it can be replaced."""

    def __init__(self, folder: str, fetch: Callable[[str, str], None] = fetch_url, workers: int = 8):
        self.folder, self.fetch, self.workers = folder, fetch, workers

    def path_of(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest()[:16] + "_" + os.path.basename(url.split("?")[0]))

    def download(self, url: str) -> str:
        target = self.path_of(url)
        if not os.path.exists(target):
            os.makedirs(self.folder, exist_ok=True)
            self.fetch(url, target + ".part")
            os.replace(target + ".part", target)
        return target

    def download_many(self, urls: Sequence[str]) -> list[str]:
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(self.download, urls))

    def extract(self, path: str) -> str:
        """Folder or file that an archive unpacks to; other files stay as they are."""
        out = path + ".extracted"
        if os.path.exists(out):
            return out
        if path.endswith((".tar.gz", ".tgz", ".tar")):
            with tarfile.open(path) as t:
                t.extractall(out, filter="data")
        elif path.endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                z.extractall(out)
        elif path.endswith(".gz"):
            out = path[:-3]
            with gzip.open(path) as r, open(out + ".part", "wb") as f:
                shutil.copyfileobj(r, f)
            os.replace(out + ".part", out)
        else:
            return path
        return out

    def download_and_extract(self, url: str) -> str:
        return self.extract(self.download(url))
