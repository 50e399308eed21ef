"""All registered queries; importing the modules fills the registry."""

from . import checks_contracts, checks_graph, checks_hash, checks_plans, checks_relational, checks_shapes  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
