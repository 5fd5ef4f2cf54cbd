"""Relational operators: aggregates over declared domains, key joins, band joins, blocking, and the query workload."""
