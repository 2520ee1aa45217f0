"""Regulatory-impact analytics expressed as Spark DataFrame plans."""
