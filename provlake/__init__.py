"""provlake: provenance-first dataset acquisition and analytics on PySpark."""
