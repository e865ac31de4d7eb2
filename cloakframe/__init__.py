"""Text privacy analytics on Spark: detection, surrogates, reversible state, and their evaluation."""
