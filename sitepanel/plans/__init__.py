"""The three analyses end to end: growth panel, season and cover, interactions."""
