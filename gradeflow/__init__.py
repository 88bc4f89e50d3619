"""Analytics for model-evaluation tables, as DataFrame expressions."""
