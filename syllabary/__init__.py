"""Spark jobs for catalogue-style data: cleaning, extraction, classification, entity merging and reports."""
