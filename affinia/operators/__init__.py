"""Operators over DataFrames: each takes DataFrames and gives one, lazily, unless it says otherwise."""
