"""All queries of the library and their DuckDB SQL."""

from . import analysis, learned, learning, market, profile, trading  # noqa: F401  each registers its queries

QUERIES = market.Q
ORACLES = market.SQL
