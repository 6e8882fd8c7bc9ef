"""Relational operators over versions, changes, deltas, spans, predictions."""
