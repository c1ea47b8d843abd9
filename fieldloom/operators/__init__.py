"""Operators on graphs, fields, kernels, transport plans and meshes kept as DataFrames."""
