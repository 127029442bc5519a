"""Registers the queries of the library."""

from . import q_code, q_experiments, q_graph, q_memory, q_profile, q_rank, q_relational, q_sources, q_text, q_windows, q_work  # noqa: F401
