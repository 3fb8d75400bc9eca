"""Price intelligence on Spark: parse, normalise, score, rank and serve offers."""
