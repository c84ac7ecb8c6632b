"""End-user queries: pure functions from tables and an ``as_of`` instant to a DataFrame."""
