"""Demand analysis of call-for-service events as Spark DataFrame operations."""
