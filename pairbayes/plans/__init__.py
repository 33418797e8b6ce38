"""Compositions: training loops, prediction, registered queries."""
