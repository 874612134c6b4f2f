"""Queries of the verification and review operators, and their SQL."""

from veritrail.oracles import ORACLES  # noqa: F401
from veritrail.queries import QUERIES

FLAGSHIP = QUERIES["verify_cases"]
