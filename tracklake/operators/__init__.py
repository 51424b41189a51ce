"""DataFrame-in, DataFrame-out operators with column-name parameters."""
