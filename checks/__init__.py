"""Driver-table views, registered queries and their oracle SQL."""
