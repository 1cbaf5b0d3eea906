"""Mention detection, disambiguation and scoring operators."""
