"""Streams of vectors against a fixed database or codebook. An extension: nothing here is needed by the batch operators."""
