"""Image files as a stream: each file counts once, in the order of a log of arrivals.

An offset is a number of files of the log, so a batch that is repeated after a failure has the same files. The log lies in the folder of option log, in
storage that drivers share; an entry is named by the number of files before it and written whole before it counts."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSourceStreamReader

from tessera.sources.files import exists, listed, move, read_bytes, write_bytes


class Arrivals(DataSourceStreamReader):
    """Options path: the folder that files are moved into, whole; log: the folder of the log; files: how many a batch takes at most (no bound unless
    given). parts(paths) and read(part) are the format's, ending is its files' ending. Files whose names begin with . or _ are not looked at."""

    ending = ""
    _known: list[str] | None = None

    def _log(self) -> list[str]:
        """All files of the log, in order; read once, then kept."""
        if self._known is None:
            self._known = []
            if exists(self.o["log"]):
                for entry in sorted(e for e in listed(self.o["log"]) if e.endswith(".json")):
                    self._known += json.loads(read_bytes(entry))
        return self._known

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        known = self._log()
        seen, most = set(known), int(self.o.get("files", 0))
        name = lambda p: p.rsplit("/", 1)[-1]
        there = listed(self.o["path"]) if exists(self.o["path"]) else []
        new = [p for p in there if p not in seen and p.endswith(self.ending) and name(p)[0] not in "._"]
        new = new[:most] if most else new
        if new:
            entry = f"{self.o['log']}/{len(known):012d}"
            write_bytes(entry + ".part", json.dumps(new).encode())
            move(entry + ".part", entry + ".json")
            known += new
        return {"files": len(known)}

    def partitions(self, start: dict, end: dict):
        return self.parts(self._log()[start["files"] : end["files"]])

    def commit(self, end: dict) -> None:
        """Nothing to do: the log stays, for it says what has been seen."""
