"""Joins, climate features, panels, models and plot tables as DataFrame operators."""
