"""profilespark: profile and fingerprint analytics as Spark DataFrame operators."""
