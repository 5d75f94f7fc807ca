"""The registered queries over the driver tables and their SQL twins."""

from __future__ import annotations

from orrery.plans import q_aggregate, q_evaluate, q_evaluation, q_features, q_more, q_parse, q_sources, q_spatial, q_windows  # noqa: F401  they register
from orrery.plans.registry import ORACLE, QUERIES  # noqa: F401
