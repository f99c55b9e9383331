"""Scholion: bibliometric integration and analytics on Spark DataFrames."""
