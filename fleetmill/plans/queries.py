"""All registered queries."""

from . import data_queries, evaluation_queries, feature_queries, model_queries, resampling_queries, signal_queries  # noqa: F401  they register
from .registry import QUERIES  # noqa: F401
