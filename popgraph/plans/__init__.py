"""Whole studies, composed of operators."""
