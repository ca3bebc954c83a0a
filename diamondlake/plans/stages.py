"""Nightly and monthly runs: stages one after another, a failed one logged and passed over."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators import runs
from ..sources import layout
from ..streaming import serve_games

log = logging.getLogger(__name__)

Stage = tuple[str, Callable[[], object]]


def run_stages(stages: list[Stage]) -> dict[str, Exception | None]:
    """Each stage's name with its error, if it had one. Later stages run whatever earlier ones did."""
    out: dict[str, Exception | None] = {}
    for name, stage in stages:
        began, out[name] = time.monotonic(), None
        try:
            stage()
        except Exception as error:
            out[name] = error
            log.exception("%s failed after %.1f s", name, time.monotonic() - began)
        else:
            log.info("%s done in %.1f s", name, time.monotonic() - began)
    log.info("failed stages: %s", ", ".join(n for n, e in out.items() if e) or "none")
    return out


def schedule(spark: SparkSession, raw: str, tree: str, state: str, matrix: str, today: dt.date, monthly: bool = False, more: list[Stage] = ()) -> list[Stage]:
    """New files are served every night; once a month the tree is compacted and the matrix made anew. ``more`` are
    nightly stages that the caller brings, such as the biography's."""
    nightly: list[Stage] = [("serve", lambda: serve_games(spark, raw, tree, state).awaitTermination()), *more]
    late: list[Stage] = [
        ("compact", lambda: layout.compact(spark, tree, today)),
        ("matrix", lambda: runs.write_matrix(layout.read_tree(spark, tree), matrix)),
    ]
    return nightly + (late if monthly else [])
