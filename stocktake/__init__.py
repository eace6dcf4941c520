"""stocktake: audit file collections against reference catalogs on Spark."""
