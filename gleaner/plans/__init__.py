"""Whole plans: the engine, its settings, evaluation."""
