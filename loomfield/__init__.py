"""Part of loomfield."""
