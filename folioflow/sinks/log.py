"""A batch's log file on the driver: lines are appended and reach the disk now and then; a log never stops a run."""

from __future__ import annotations

import os
from datetime import UTC, datetime

#: Lines after which the file is forced to disk.
LINES = 300


class BatchLog:
    """Appends lines to a file; after the first error of the file system it stays silent and ``error`` says why."""

    def __init__(self, path: str, every: int = LINES):
        self.every, self.lines, self.error = every, 0, None
        try:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            self.file = open(path, "a", encoding="utf-8")
        except OSError as e:
            self.file, self.error = None, str(e)

    def write(self, line: str) -> None:
        if self.file is None:
            return
        try:
            self.file.write(f"{datetime.now(UTC).isoformat(timespec='seconds')} {line.rstrip()}\n")
            self.lines += 1
            if self.lines % self.every == 0:
                self.sync()
        except (OSError, ValueError) as e:
            self.file, self.error = None, str(e)

    def sync(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        if self.file is not None:
            try:
                self.sync()
                self.file.close()
            except (OSError, ValueError) as e:
                self.error = str(e)
            self.file = None
