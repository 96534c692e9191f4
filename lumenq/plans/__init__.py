"""Registered queries over the driver's tables."""

from . import box_queries, image_queries, ml_queries, pixel_queries, record_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
