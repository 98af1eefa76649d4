"""Log lines as JSON objects."""

from __future__ import annotations

import json
import logging
import sys
from typing import TextIO

_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """One object for each record: time, level, logger, message and whatever ``extra`` holds."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False, default=str)


def setup_logging(level: int | str = "INFO", stream: TextIO | None = None) -> logging.Logger:
    """The package's logger, writing JSON lines; called again, it replaces its handler."""
    log = logging.getLogger("fieldspark")
    log.handlers[:] = [logging.StreamHandler(stream or sys.stderr)]
    log.handlers[0].setFormatter(JsonLines())
    log.setLevel(level)
    log.propagate = False
    return log
