"""What is computed over an inventory: scans, duplicates, reclaiming, removal, layout."""
