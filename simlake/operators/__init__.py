"""Operators over DataFrames: scoring, encoding, training, clustering, statistics, losses."""
