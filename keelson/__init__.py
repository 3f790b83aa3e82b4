"""Keelson: few-shot dataset analytics on Spark."""
