"""Readers and writers of station tables, grids and vector layers."""
