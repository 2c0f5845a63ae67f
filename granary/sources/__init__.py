"""Inventories: of a live directory tree, of a stored snapshot, or made from any table with paths and contents."""
