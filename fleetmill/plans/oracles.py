"""DuckDB SQL of the registered queries."""

from . import queries  # noqa: F401  it registers
from .registry import ORACLES  # noqa: F401
