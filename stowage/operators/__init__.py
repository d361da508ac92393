"""Relational operators: graphs, hierarchies, stores, intervals, compaction."""
