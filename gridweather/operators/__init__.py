"""DataFrame in, DataFrame out: lookups, neighbours, statistics, metrics, ordered series, samples, tables, models."""
