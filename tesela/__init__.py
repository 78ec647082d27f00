"""Tesela: procurement analytics and data preparation as Spark plans."""
