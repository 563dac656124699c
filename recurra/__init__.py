"""Ordered-observation analytics on Spark: chains, recurrence, consolidation,
versioned memory and paired evaluation as DataFrame operators."""
