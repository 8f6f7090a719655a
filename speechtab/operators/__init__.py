"""DataFrame-in, DataFrame-out operators; everything stays lazy."""
