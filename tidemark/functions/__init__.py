"""Shared aggregates: moments, value counts, co-moments, histograms, exact quantiles, prefix sums."""
