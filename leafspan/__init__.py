"""Leafspan: document reconstruction and text analytics expressed as Spark plans."""
