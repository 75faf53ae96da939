"""deltashelf: product-change intelligence on Spark."""
