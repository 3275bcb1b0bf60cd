"""Jobs over the driver's tables, by area."""

from folioscan.registry import answers, asking, audits, building, retrieval, streams, turns  # noqa: F401
from folioscan.registry.common import ORACLES, QUERIES  # noqa: F401
