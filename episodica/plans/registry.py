"""All queries of the library proper, by name."""

from __future__ import annotations

from episodica.plans import dataset_queries, episode_queries, handle_queries, snapshot_queries, source_queries, store_queries, tensor_queries, window_queries

_MODULES = (window_queries, episode_queries, tensor_queries, store_queries, dataset_queries, snapshot_queries, source_queries, handle_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "temporal_window_obs"
