"""starmart: sales analytics on a star schema, written for Spark."""

from starmart.config import Config
from starmart.schema import Star

__all__ = ["Config", "Star"]
