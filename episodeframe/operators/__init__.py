"""Operators over episodes, steps and outcomes."""
