"""Price offers as DataFrames: parse, normalise, match, enrich, validate, price, report."""
