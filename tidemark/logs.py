"""Logging to a file that rotates."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path


def setup_logging(path: str, level: int = logging.INFO, most_bytes: int = 50 << 20, kept: int = 5) -> logging.Logger:
    """The package's logger, writing to `path` (a new file each most_bytes, `kept` old ones) and to the console. Calling it again changes the place, not the number of handlers."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("tidemark")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    log.setLevel(level)
    for handler in (RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept, encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log
