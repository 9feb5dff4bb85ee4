"""Analyses as DataFrame -> DataFrame operators."""
