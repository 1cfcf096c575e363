"""Operators: functions from DataFrames to DataFrames. Reading and writing stay at the edges."""
