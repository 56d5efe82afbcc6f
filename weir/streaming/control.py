"""The control table of running applications: signals, active alternates, instance counts and stops; the latest row wins.

With a folder, rows are files in it, so that another process (``weir.cli``) can
send them, and the engine writes the status of its applications there.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Control:
    app: str
    node: str
    kind: str  # signal, alternate or scale
    payload: object
    at: float


class ControlTable:
    def __init__(self, folder: str | None = None):
        self._rows: dict[tuple[str, str, str], Control] = {}
        self._lock = threading.Lock()
        self.folder = folder
        if folder:
            os.makedirs(folder, exist_ok=True)

    def send(self, app: str, node: str, kind: str, payload: object) -> None:
        """Leave a row for the engine that reads the folder."""
        name = f"{self.folder}/{time.time_ns()}-{uuid.uuid4().hex}"
        with open(name + ".part", "w") as f:
            json.dump(asdict(Control(app, node, kind, payload, time.time())), f)
        os.replace(name + ".part", name + ".control")

    def receive(self, app: str) -> list[Control]:
        """Rows for ``app`` that were sent since, oldest first."""
        found = []
        for name in sorted(os.listdir(self.folder)) if self.folder else []:
            if name.endswith(".control"):
                with open(f"{self.folder}/{name}") as f:
                    row = Control(**json.load(f))
                if row.app == app:
                    found.append(row)
                    os.remove(f"{self.folder}/{name}")
        return found

    def report(self, app: str, status: str) -> None:
        if self.folder:
            with open(f"{self.folder}/{app}.status", "w") as f:
                f.write(status)

    def reported(self, app: str) -> str | None:
        path = f"{self.folder}/{app}.status"
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return f.read()

    def put(self, app: str, node: str, kind: str, payload: object) -> Control:
        row = Control(app, node, kind, payload, time.time())
        with self._lock:
            self._rows[app, node.lower(), kind] = row
        return row

    def get(self, app: str, node: str, kind: str) -> Control | None:
        """The latest row; node names of signals match in either case."""
        with self._lock:
            return self._rows.get((app, node.lower(), kind))

    def drop(self, app: str) -> None:
        with self._lock:
            self._rows = {k: v for k, v in self._rows.items() if k[0] != app}
