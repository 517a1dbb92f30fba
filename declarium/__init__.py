"""Analytics on declaration records: plain functions from DataFrame to DataFrame."""

from declarium.schema import Columns

__all__ = ["Columns"]
