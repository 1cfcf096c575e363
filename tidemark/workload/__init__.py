"""Registered queries over the benchmark tables, each beside the SQL it must agree with."""
