"""Whole plans, reports and the command line."""
