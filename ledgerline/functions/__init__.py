"""Column expressions and staged projections; no UDF anywhere."""
