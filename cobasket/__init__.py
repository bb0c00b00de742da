"""Basket and item-affinity analytics as Spark DataFrame jobs."""

from cobasket.params import Params
from cobasket.session import build_session

__all__ = ["Params", "build_session"]
