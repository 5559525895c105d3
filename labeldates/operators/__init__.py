"""Operators: candidate dates, choice, layers, cascade, geometry, evaluation, quality, sampling."""
