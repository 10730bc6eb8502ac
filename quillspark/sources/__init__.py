"""Sources of the document engine."""
