"""Whole flows (corpus preparation, grid training, run analysis) and the registered queries."""
