"""Operators over DataFrames: generation, profiling, masking, validation, drift, sinks."""
