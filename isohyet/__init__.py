"""Station-to-grid analytics on Spark: tidy sensor observations, resample them, regress on elevation, write grids."""
