"""Readers, writers and the adapters that shape source tables into `calls` and `areas`."""
