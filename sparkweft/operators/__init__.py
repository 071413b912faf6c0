"""Set-oriented operators: DataFrames in, DataFrames out, keyed by project_id."""
