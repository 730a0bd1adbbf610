"""Factor catalogs: names and trees of published formulas."""
