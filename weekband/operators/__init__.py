"""DataFrame operators: series, shares, profiles, distributions, areas, space, forecasts."""
