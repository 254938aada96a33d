"""Physical-plan helpers: skew, lineage, numbering, selection."""
