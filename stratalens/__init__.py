"""Sample-representativeness analytics as Spark DataFrame operators."""

from stratalens.session import build_session
from stratalens.operators.strata import Dimension

__all__ = ["Dimension", "build_session"]
