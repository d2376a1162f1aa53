"""Readers and the bindings of the test tables to the episode model."""
