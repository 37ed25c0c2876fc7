"""DataFrame-in, DataFrame-out operators; column names are always arguments."""
