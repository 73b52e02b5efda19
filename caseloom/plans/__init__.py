"""Whole jobs: build a dataset, train and select, score, retrain."""
