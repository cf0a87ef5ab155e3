"""All registered queries. Importing a module of queries registers them."""

from . import graphs, records, retrieval, scalar, sourcecode  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
