"""labeldates: expiry dates from product-label text, as PySpark DataFrame programs."""
