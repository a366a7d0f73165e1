"""Relational operators over detections."""
