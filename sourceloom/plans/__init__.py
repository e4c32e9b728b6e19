"""Plans of sourceloom."""
