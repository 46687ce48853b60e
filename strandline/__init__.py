"""strandline: path-collection analytics expressed as ordinary Spark plans."""
