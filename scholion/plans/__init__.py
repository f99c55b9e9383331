"""Models and queries: what is computed, put together from operators."""
