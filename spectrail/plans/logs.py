"""The driver's log: lines to a file, to the terminal, or both, and uncaught errors among them.

`sources.tables.read_log` reads such a file back as a table.
"""

from __future__ import annotations

import logging
import sys
from datetime import datetime
from pathlib import Path
from types import TracebackType

NAME = "spectrail"
LINE = "%(asctime)s [%(threadName)-12.12s] [%(levelname)-8.8s] %(message)s"
PLAIN = "%(levelname)-8.8s %(message)s"


def set_up(verbose: bool = False, folder: str | None = ".", name: str | None = None, terminal: bool = True) -> logging.Logger:
    """The package's logger. Its handlers are those of the last call; `folder` None writes no file, and `name` is by default the time."""
    log = logging.getLogger(NAME)
    log.propagate = False
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    if folder is not None:
        stamp = datetime.now().strftime("%Y-%m-%d_%H-%M-%S")
        to_file = logging.FileHandler(Path(folder) / f"{name or f'{NAME}_{stamp}'}.log", encoding="utf-8")
        to_file.setFormatter(logging.Formatter(LINE))
        log.addHandler(to_file)
    if terminal:
        to_terminal = logging.StreamHandler(sys.stdout)
        to_terminal.setFormatter(logging.Formatter(PLAIN))
        log.addHandler(to_terminal)
    sys.excepthook = report
    return log


def report(kind: type[BaseException], error: BaseException, trace: TracebackType | None) -> None:
    """Log an uncaught error; an interrupt goes to the usual hook."""
    if issubclass(kind, KeyboardInterrupt):
        sys.__excepthook__(kind, error, trace)
        return
    logging.getLogger(NAME).critical("uncaught error", exc_info=(kind, error, trace))
