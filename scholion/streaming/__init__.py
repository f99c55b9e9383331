"""Increments: file streams that stop when they have caught up, appends by batch, windows over event time."""
