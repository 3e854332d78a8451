"""A federated metadata-catalogue engine expressed as Spark DataFrame plans."""
