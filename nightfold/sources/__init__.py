"""Readers and sinks for the file formats the operators are fed from."""
