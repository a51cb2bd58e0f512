"""The query catalogue."""

from . import context, graph, lifecycle, mining, retrieval, views  # noqa: F401, I001
from . import assembly, records  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
