"""Log messages of the driver: one parent logger, quiet unless asked."""

from __future__ import annotations

import logging

ROOT = "brackwater"
logging.getLogger(ROOT).addHandler(logging.NullHandler())


def get_logger(name: str = ROOT) -> logging.Logger:
    """A logger below the package's own."""
    return logging.getLogger(name if name == ROOT or name.startswith(f"{ROOT}.") else f"{ROOT}.{name}")


def set_loglevel(level: int | str, match: str = "", handler: logging.Handler | None = None) -> None:
    """Level of the package's loggers whose names hold match; messages go to handler, by default to standard error, which is set up once."""
    root = logging.getLogger(ROOT)
    if handler or not any(getattr(h, "own", False) for h in root.handlers):
        h = handler or logging.StreamHandler()
        h.setFormatter(h.formatter or logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        h.own = True
        root.handlers = [x for x in root.handlers if not getattr(x, "own", False)] + [h]
    names = [ROOT, *[n for n in logging.root.manager.loggerDict if n.startswith(f"{ROOT}.")]]
    for n in names:
        if match in n:
            logging.getLogger(n).setLevel(level)
