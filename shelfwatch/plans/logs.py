"""The run's log: on the console and in a file that is rotated."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

from shelfwatch.sources.config import Settings

# Size and number of log files.
MOST_BYTES, FILES = 5_000_000, 5


def logger(settings: Settings) -> logging.Logger:
    """The engine's logger as the settings say; called again it replaces its handlers."""
    log = logging.getLogger("shelfwatch")
    for h in log.handlers[:]:
        log.removeHandler(h)
        h.close()
    log.setLevel(settings.log_level.upper())
    log.propagate = False
    Path(settings.log_path).parent.mkdir(parents=True, exist_ok=True)
    for h in (logging.StreamHandler(), RotatingFileHandler(settings.log_path, maxBytes=MOST_BYTES, backupCount=FILES, encoding="utf-8")):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


def snippet(text: str, most: int) -> str:
    """The first so many characters, all of them if it is 0 or less."""
    return text if most <= 0 or len(text) <= most else f"{text[:most]}..."
