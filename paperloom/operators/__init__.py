"""Relational operators: listings, joins, latest-state views, statistics, trees, vectors and layout metrics."""
