"""Barcode-sequencing analytics expressed as Spark DataFrame plans."""
