"""All registered queries."""

from . import form_queries, model_queries, reading_queries, record_queries, region_queries, schema_queries, small_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
