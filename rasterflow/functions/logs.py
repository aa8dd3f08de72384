"""The program's log: a file beside the standard error stream, begun anew when it has grown."""

from __future__ import annotations

import logging
import sys
from pathlib import Path

#: The size at which a log is begun anew, its folder and name, what the old one is called, and the levels by name.
LIMIT, FOLDER, NAME, OLD = 1 << 20, "log", "app.log", "app.log.1"
LEVELS = {"off": logging.CRITICAL + 10, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}


class _Quiet(logging.StreamHandler):
    """Standard error, where there is one: what can't be written there is in the file."""

    def handleError(self, record: logging.LogRecord) -> None:
        pass


def level(text: str) -> int:
    """By name in any ASCII case; warnings where unknown."""
    return LEVELS.get(text.lower() if text.isascii() else "", logging.WARNING)


def open_log(folder: str, text: str = "warn", name: str = "rasterflow") -> logging.Logger:
    """A logger to standard error and to the file in ``folder``, if it names one. A file over the limit is kept once; opening again begins anew."""
    log = logging.getLogger(name)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [_Quiet(sys.stderr)]
    if folder:
        at = Path(folder) / FOLDER / NAME
        try:
            at.parent.mkdir(parents=True, exist_ok=True)
            if at.exists() and at.stat().st_size > LIMIT:
                at.replace(at.with_name(OLD))
            handlers.append(logging.FileHandler(at, encoding="utf-8"))
        except OSError:
            pass  # standard error alone
    for h in handlers:
        h.setFormatter(logging.Formatter("[%(asctime)s] [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S"))
        log.addHandler(h)
    log.setLevel(level(text))
    log.propagate = False
    return log


def start(folder: str, verbose: bool, title: str, version: str, files: int) -> logging.Logger:
    """The log of a run, which begins with how many files it was given; more is told when verbose."""
    log = open_log(folder, "debug" if verbose else "info")
    log.info("%s %s 启动,命令行传入文件 %d 个", title, version, files)
    return log
