"""Operators on level series, masks, labels and timelines."""
