"""SQL that recomputes every query on a second engine."""
