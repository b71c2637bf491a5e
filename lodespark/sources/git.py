"""A streaming source over a working tree: what is new since the last commit or listing comes as change jobs.

The offset is a snapshot's digest and number; the first batch lists every file as A, later ones give A, M and D between
two snapshots, and an unchanged tree gives none. Snapshots are kept as small JSON files beside the checkpoint, so a
restarted query reads the same changes again. The listing runs on the driver, as a git client would."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "file_path string, change_type string, commit_sha string"


def in_repository(root: str) -> bool:
    at = os.path.abspath(root)
    while not os.path.exists(os.path.join(at, ".git")):
        if at == os.path.dirname(at):
            return False
        at = os.path.dirname(at)
    return True


def listing(root: str) -> dict[str, str]:
    """path -> content hash of a repository's tracked files (git ls-files; its errors are raised), or of all files where there is no repository."""
    if in_repository(root):
        out = subprocess.run(["git", "-C", root, "ls-files", "-s", "-z"], capture_output=True, text=True, check=True).stdout
        return {r.partition("\t")[2]: r.split()[1] for r in out.split("\0") if r.strip()}
    found = {}
    for base, _, names in os.walk(root):
        for n in names:
            p = os.path.join(base, n)
            with open(p, "rb") as f:
                found[os.path.relpath(p, root)] = hashlib.file_digest(f, "sha1").hexdigest()
    return found


def changes(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str]]:
    out = [(p, "A" if p not in before else "M") for p in sorted(after) if before.get(p) != after[p]]
    return out + [(p, "D") for p in sorted(before) if p not in after]


class TreeSource(DataSource):
    """spark.readStream.format("tree").option("root", ...).option("state", ...)"""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"], self.options["state"])


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, state
        os.makedirs(state, exist_ok=True)

    def _path(self, sha: str) -> str:
        return os.path.join(self.state, f"{sha}.json")

    def _load(self, sha: str) -> dict[str, str]:
        if not sha:
            return {}
        with open(self._path(sha)) as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listing(self.root)
        sha = hashlib.sha1(json.dumps(now, sort_keys=True).encode()).hexdigest()
        if not os.path.exists(self._path(sha)):
            with open(self._path(sha) + ".tmp", "w") as f:
                json.dump(now, f)
            os.replace(self._path(sha) + ".tmp", self._path(sha))
        return iter([(p, c, sha) for p, c in changes(self._load(start["sha"]), now)]), {"sha": sha}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(p, c, end["sha"]) for p, c in changes(self._load(start["sha"]), self._load(end["sha"]))])

    def commit(self, end: dict) -> None:
        """Nothing to acknowledge: offsets are in the query's checkpoint."""
