"""A client of dataset hubs that speak the public HTTP interface: listing, information, downloads and commits of one revision."""

from __future__ import annotations

import base64
import json
import os
import shutil
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from sparkset.sources.resolve import configs_of

#: Rows of a directory listing that one answer has.
PAGE = 1000


class HubError(RuntimeError):
    """An answer other than success, with its status."""

    def __init__(self, status: int, address: str):
        super().__init__(f"{status} from {address}")
        self.status = status


@dataclass(frozen=True)
class HttpClient:
    """Fits ``hub.push``, ``hub.delete`` and ``hub.HubSource``. The token, if any, is sent as a bearer token and to the endpoint alone."""

    endpoint: str = "https://huggingface.co"
    revision: str = "main"
    token: str | None = None
    timeout: float = 60

    def _open(self, address: str, body: bytes | None = None, kind: str = "application/json"):
        headers = {"Content-Type": kind} if body is not None else {}
        request = urllib.request.Request(f"{self.endpoint}{address}", body, headers)
        if self.token:  # not passed on where the hub sends us to another host
            request.add_unredirected_header("Authorization", f"Bearer {self.token}")
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise HubError(e.code, address) from e

    def _json(self, address: str, body: bytes | None = None, kind: str = "application/json"):
        with self._open(address, body, kind) as r:
            return json.loads(r.read() or b"null")

    def info(self, repo: str) -> dict:
        """What the hub says of a dataset."""
        return self._json(f"/api/datasets/{quote(repo)}/revision/{quote(self.revision, safe='')}")

    def exists(self, repo: str) -> bool:
        try:
            self.info(repo)
        except HubError as e:
            if e.status in (401, 403, 404):
                return False
            raise
        return True

    def list_tree(self, repo: str) -> Iterator[dict]:
        """Files with path and size, over all pages of the listing."""
        address = f"/api/datasets/{quote(repo)}/tree/{quote(self.revision, safe='')}?recursive=true&limit={PAGE}"
        while address:
            with self._open(address) as r:
                found = json.loads(r.read())
                following = [x.split(";")[0].strip()[1:-1] for x in (r.headers.get("Link") or "").split(",") if 'rel="next"' in x]
            yield from (f for f in found if f["type"] == "file")
            address = following[0].removeprefix(self.endpoint) if following else None

    def list_files(self, repo: str) -> list[str]:
        return sorted(f["path"] for f in self.list_tree(repo))

    def configs(self, repo: str) -> list[str]:
        """Configurations: those the dataset's card names, or else folders of its files."""
        card = (self.info(repo).get("cardData") or {}).get("configs") or []
        return [c["config_name"] for c in card] or configs_of(self.list_files(repo))

    def file_url(self, repo: str, path: str) -> str:
        return f"{self.endpoint}/datasets/{quote(repo)}/resolve/{quote(self.revision, safe='')}/{quote(path)}"

    def download(self, repo: str, path: str, local: str) -> None:
        with self._open(self.file_url(repo, path).removeprefix(self.endpoint)) as r, open(local, "wb") as f:
            shutil.copyfileobj(r, f)

    def stream(self, repo: str, path: str, size: int = 65536) -> Iterator[bytes]:
        with self._open(self.file_url(repo, path).removeprefix(self.endpoint)) as r:
            yield from iter(lambda: r.read(size), b"")

    def create_repo(self, repo: str, private: bool = False) -> None:
        """Make a dataset; one that is there already is left as it is."""
        owner, _, name = repo.rpartition("/")
        body = {"type": "dataset", "name": name, "private": private} | ({"organization": owner} if owner else {})
        try:
            self._json("/api/repos/create", json.dumps(body).encode())
        except HubError as e:
            if e.status != 409:
                raise

    def _commit(self, repo: str, summary: str, operation: dict) -> None:
        lines = [{"key": "header", "value": {"summary": summary}}, operation]
        body = "\n".join(map(json.dumps, lines)).encode()
        self._json(f"/api/datasets/{quote(repo)}/commit/{quote(self.revision, safe='')}", body, "application/x-ndjson")

    def upload(self, repo: str, path: str, local: str) -> None:
        """Commit a file; it is held in memory, so shards should stay within the hub's limit for plain commits."""
        with open(local, "rb") as f:
            content = base64.b64encode(f.read()).decode()
        self._commit(repo, f"Add {os.path.basename(path)}", {"key": "file", "value": {"path": path, "content": content, "encoding": "base64"}})

    def delete(self, repo: str, path: str) -> None:
        self._commit(repo, f"Delete {os.path.basename(path)}", {"key": "deletedFile", "value": {"path": path}})
