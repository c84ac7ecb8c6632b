"""Reusable DataFrame operators: idle-capped time, statistics, ranking, tags, ledgers."""
