"""Tidemark: delivered files and change feeds become a star schema with history, as Spark jobs."""
