"""folio: catalogue analytics expressed as Spark plans."""
