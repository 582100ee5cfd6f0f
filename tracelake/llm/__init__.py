"""Training-data operators: near-duplicate joins, filters, scoring, mixing, sharding and token counts."""
