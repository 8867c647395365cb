"""lumidoc: document analytics expressed as Spark DataFrame plans."""
