"""threatquery: phishing / smishing analytics expressed as PySpark DataFrame transforms."""
