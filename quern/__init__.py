"""quern: corpus curation, packing and evaluation expressed as Spark plans."""
