"""labelsift: label-quality analytics expressed as Spark DataFrame plans."""
