"""Plan shapes (ordered look-ups, interval joins, look-up joins) and the end-to-end flows."""
