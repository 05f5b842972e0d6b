"""Turnloom: typed, attributed, traceable context from tables of chat turns, on Spark."""

__version__ = "0.1.0"
