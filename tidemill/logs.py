"""Where messages go."""

from __future__ import annotations

import logging


def configure(level: int = logging.INFO, path: str | None = None) -> logging.Logger:
    """The package's logger, with one handler to the shell and, if a path is given, one to that file; called again it replaces them."""
    log = logging.getLogger("tidemill")
    log.setLevel(level)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
        log.addHandler(handler)
    return log
