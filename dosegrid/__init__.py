"""Sparse genotype tables, association weights and polygenic scores on Spark."""
