"""Set-at-a-time barcode detection analytics on Spark."""
