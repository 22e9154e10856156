"""All queries over the event tables."""

from . import backlog, basics, detectors, features, statistics, streams, upkeep, words  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
