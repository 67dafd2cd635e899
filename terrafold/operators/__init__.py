"""DataFrame operators: spatial joins, graphs, sampling, metrics, matching, models, search."""
