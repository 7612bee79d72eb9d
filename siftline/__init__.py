"""Listing-curation engine on Spark: sources, scalar rules, stages, stores, runs and queries."""
