"""Episodica: episodic trajectory datasets and training-data preparation as Spark plans."""
