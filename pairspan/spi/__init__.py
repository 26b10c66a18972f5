"""Statistics of pairwise interaction: each estimator maps a panel to rows (spi, sample_id, node_from, node_to, value)."""
