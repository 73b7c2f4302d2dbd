"""Composable operators: DataFrames in, DataFrames out, lazily."""
