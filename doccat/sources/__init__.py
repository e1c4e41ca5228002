"""Sources: table readers and adapters from landed raw data to catalog-shaped frames."""
