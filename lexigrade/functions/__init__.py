"""Part of lexigrade."""
