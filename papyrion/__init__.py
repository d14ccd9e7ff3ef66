"""Papyrion: document knowledge-graph analytics as Spark DataFrame operators."""
