"""Whole analyses put together from the operators. Each is one lazy plan."""
