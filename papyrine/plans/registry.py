"""Every query of the library, by name, with its SQL twin."""

from __future__ import annotations

from papyrine.plans import graphs, models, scores, splits, streams, texts  # noqa: F401  they register their queries
from papyrine.plans.base import ORACLES, QUERIES  # noqa: F401
