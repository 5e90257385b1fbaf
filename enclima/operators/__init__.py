"""DataFrame -> DataFrame operators (long canonical model, wide at the edges)."""
