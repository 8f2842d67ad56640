"""bandweave: engineering-evidence analytics expressed as Spark DataFrame plans."""
