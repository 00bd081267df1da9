"""Comparable-well ("analog") forecasting as composable Spark DataFrame operators."""
