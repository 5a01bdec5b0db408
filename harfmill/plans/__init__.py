"""The query catalogue: `QUERIES` by name and `ORACLES`, their DuckDB SQL."""

from harfmill.plans import benchmarks, more, morphology, text, tokens  # noqa: F401
from harfmill.plans.base import ORACLES, QUERIES  # noqa: F401
