"""Plans of the document engine."""
